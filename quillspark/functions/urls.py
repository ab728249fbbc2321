"""URL functions as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: path parts that are never followed.
BLOCKED = (r"/sign-?in(?:/|[?#]|$)", r"/videos?(?:/|[?#]|$)", r"/films?(?:/|[?#]|$)", r"/podcast(?:/|[?#]|$)", r"/live(?:/|[?#]|$)")


#: Fixed value: what a crawl takes below its root.
SECTIONS = ("^(?:news|athletes|olympic-games)(?:/.*)?$", "^sports/[^/]+/.+$")
#: Fixed value: names of entity pages.
ENTITY_PAGE = "[a-z0-9-]+/?"


@dataclass(frozen=True)
class CrawlRules:
    """Which URLs a crawl takes: those of ``domain`` under /``root``/ whose rest matches one of ``sections``, and none of
    ``blocked``. ``entity``: the section whose direct pages come first."""

    domain: str
    root: str = "en"
    sections: tuple[str, ...] = SECTIONS
    entity: str = "athletes"
    blocked: tuple[str, ...] = BLOCKED

    @property
    def site(self) -> str:
        return rf"^https?://(?:www\.)?{re.escape(self.domain)}/{self.root}"

    def accepts(self, url: Column) -> Column:
        rest = F.regexp_replace(url, f"^(?s).*?/{self.root}/", "")
        inside = url.rlike(rf"{self.site}(?:/|$)")
        taken, barred = F.lit(False), F.lit(False)
        for s in self.sections:
            taken = taken | rest.rlike(s)
        for b in self.blocked:
            barred = barred | url.rlike(b)
        return F.coalesce(inside & taken & ~barred, F.lit(False))

    def tier(self, url: Column) -> Column:
        """0 for a page of one entity, 1 for a source of further links."""
        return F.when(url.rlike(rf"{self.site}/{self.entity}/{ENTITY_PAGE}$"), 0).otherwise(1)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, host without www, user and port, path as it is ('/' if empty), no query or fragment."""
    part = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?)?([^?#]*)"
    scheme, host, path = F.lower(F.regexp_extract(url, part, 1)), F.lower(F.regexp_extract(url, part, 2)), F.regexp_extract(url, part, 3)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path)


def doc_id(url: Column) -> Column:
    """The first 64 bits of the URL's SHA-1 as an unsigned number, kept as a string."""
    return F.conv(F.substring(F.sha1(url), 1, 16), 16, 10)


def filename(url: Column) -> Column:
    """File name of a page: its path without outer slashes ('index' if empty), without the first three characters."""
    path = F.trim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    path = F.when(path == "", "index").otherwise(path)
    return F.concat(F.replace(F.substring(path, 4, 2147483647), F.lit("/"), F.lit("_")), F.lit(".html"))


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(path, r".*?(html/.*)$", 1)


def route(tier: Column, url: Column, root: str) -> Column:
    """Folder a page is stored in: entity pages in one, all others, and the entities' ``root`` page, in the other."""
    return F.when((tier == 0) & (F.rtrim(url, F.lit("/")) != root.rstrip("/")), "athletes").otherwise("lookup")

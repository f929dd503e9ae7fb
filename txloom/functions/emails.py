"""E-mail domain features."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EMAILS, col

# E-mail domain -> provider.
PROVIDERS = {
    "aim.com": "aol", "anonymous.com": "other", "aol.com": "aol", "att.net": "att", "bellsouth.net": "other",
    "cableone.net": "other", "centurylink.net": "centurylink", "cfl.rr.com": "other", "charter.net": "spectrum",
    "comcast.net": "other", "cox.net": "other", "earthlink.net": "other", "embarqmail.com": "centurylink",
    "frontier.com": "yahoo", "frontiernet.net": "yahoo", "gmail": "google", "gmail.com": "google",
    "gmx.de": "other", "hotmail.co.uk": "microsoft", "hotmail.com": "microsoft", "hotmail.de": "microsoft",
    "hotmail.es": "microsoft", "hotmail.fr": "microsoft", "icloud.com": "apple", "juno.com": "other",
    "live.com": "microsoft", "live.com.mx": "microsoft", "live.fr": "microsoft", "mac.com": "apple",
    "mail.com": "other", "me.com": "apple", "msn.com": "microsoft", "netzero.com": "other",
    "netzero.net": "other", "optonline.net": "other", "outlook.com": "microsoft", "outlook.es": "microsoft",
    "prodigy.net.mx": "att", "protonmail.com": "other", "ptd.net": "other", "q.com": "centurylink",
    "roadrunner.com": "other", "rocketmail.com": "yahoo", "sbcglobal.net": "att", "sc.rr.com": "other",
    "scranton.edu": "other", "servicios-ta.com": "other", "suddenlink.net": "other", "twc.com": "spectrum",
    "verizon.net": "yahoo", "web.de": "other", "windstream.net": "other", "yahoo.co.jp": "yahoo",
    "yahoo.co.uk": "yahoo", "yahoo.com": "yahoo", "yahoo.com.mx": "yahoo", "yahoo.de": "yahoo",
    "yahoo.es": "yahoo", "yahoo.fr": "yahoo", "ymail.com": "yahoo",
}

# Domain endings counted as United States.
US_SUFFIXES = ["gmail", "net", "edu"]


def is_proton(c: str | Column) -> Column:
    return F.coalesce(col(c) == "protonmail.com", F.lit(False))


def mapped(c: str | Column, table: dict) -> Column:
    """Look a value up in a small fixed dictionary; a miss gives null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, col(c))


def email_provider(c: str | Column) -> Column:
    return mapped(c, PROVIDERS)


def last_part(c: str | Column) -> Column:
    """The text behind the last dot; a missing value is the text nan."""
    return F.element_at(F.split(F.coalesce(col(c), F.lit("nan")), r"\."), -1)


def email_suffix(c: str | Column) -> Column:
    last = last_part(c)
    return F.when(last.isin(US_SUFFIXES), "us").otherwise(last)


def proton_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c.split("_")[0] + "_isproton": is_proton(c) for c in EMAILS})


def email_features(df: DataFrame, columns=EMAILS) -> DataFrame:
    out = {}
    for c in columns:
        out[f"{c}_bin"] = email_provider(c)
        out[f"{c}_suffix"] = email_suffix(c)
    return df.withColumns(out)

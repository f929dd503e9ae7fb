"""Browser, device, operating-system and screen features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import col
from .ratios import ratio

# Browser versions that count as current.
LATEST_BROWSERS = [
    "samsung browser 7.0", "opera 53.0", "mobile safari 10.0", "google search application 49.0", "firefox 60.0",
    "edge 17.0", "chrome 69.0", "chrome 67.0 for android", "chrome 63.0 for android", "chrome 63.0 for ios",
    "chrome 64.0", "chrome 64.0 for android", "chrome 64.0 for ios", "chrome 65.0", "chrome 65.0 for android",
    "chrome 65.0 for ios", "chrome 66.0", "chrome 66.0 for android", "chrome 66.0 for ios",
]

# Text found in the browser name -> family; the last rule that matches wins.
BROWSER_RULES = [
    ("contains", "android ", "android"), ("contains", "ie", "ie"), ("contains", "chrome", "chrome"),
    ("contains", "safari", "safari"), ("contains", "edge", "edge"), ("contains", "firefox", "firefox"),
    ("contains", "samsung", "samsung"), ("contains", "opera", "opera"), ("contains", "facebook", "facebook"),
    ("contains", "google", "google"),
]

# Text found in the device description -> maker; the last rule that matches wins.
DEVICE_RULES = [
    ("contains", "build", "handset"), ("startswith", "g3", "sony"), ("contains", "-l", "huawei"),
    ("contains", "xt", "sony"), ("contains", "sm", "samsung"), ("contains", "gt-", "samsung"),
    ("contains", "lg-", "lg"), ("contains", "rv:", "rv"), ("contains", "ale-", "huawei"),
    ("startswith", "lg", "lg"), ("contains", "moto", "motorola"), ("contains", "huawei", "huawei"),
    ("contains", "blade", "zte"), ("contains", "linux", "linux"), ("contains", "htc", "htc"),
    ("contains", "asus", "asus"), ("contains", "samsung", "samsung"), ("contains", "windows", "windows"),
    ("contains", "ios", "ios"), ("contains", "macos", "macos"), ("contains", "trident", "trident"),
    ("contains", "hisense", "hisense"), ("contains", "pixel", "pixel"), ("contains", "redmi", "redmi"),
    ("contains", "lenovo", "lenovo"), ("contains", "nexus", "nexus"), ("contains", "ilium", "ilium"),
    ("contains", "android", "android"), ("contains", "hi6210sft", "huawei"), ("contains", "f3213", "sony"),
    ("contains", "f3113", "sony"), ("contains", "microsoft", "windows"),
]


def last_match(c: str | Column, rules) -> Column:
    """Value of the last rule that holds, null when none does."""
    c = col(c)
    out = None
    for kind, needle, value in reversed(rules):
        test = c.contains(needle) if kind == "contains" else c.startswith(needle)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def latest_browser(c: str | Column = "id_31", versions=LATEST_BROWSERS) -> Column:
    return F.coalesce(col(c).isin(versions), F.lit(False)).cast("int")


def part_of(c: str | Column, separator: str, index: int) -> Column:
    """The ``index``-th piece (from 0) of a separated text, null when there is none."""
    return F.get(F.split(col(c), separator), index)


def digits_of(c: str | Column, keep: str) -> Column:
    """Remove every character outside ``keep`` (a character class body)."""
    return F.regexp_replace(col(c), f"[^{keep}]+", "")


def screen_size(c: str | Column, index: int) -> Column:
    return part_of(c, "x", index).try_cast("double")


def device_features(df: DataFrame) -> DataFrame:
    """The whole browser and device block in one projection.

    ``latest_browser`` looks at the raw browser text, all others at lower case.
    """
    device, system, browser = (F.lower(c) for c in ("DeviceInfo", "id_30", "id_31"))
    width, height = screen_size("id_33", 0), screen_size("id_33", 1)
    return df.withColumns({
        "latest_browser": latest_browser("id_31"),
        "DeviceInfo": device,
        "id_30": system,
        "id_31": browser,
        "device_version": part_of(device, "/", 1),
        "os_id_30": part_of(system, " ", 0),
        "version_id_30": digits_of(system, r"0-9_.\s"),
        "browser_id_31": last_match(browser, BROWSER_RULES),
        "version_id_31": F.concat(F.lit("a_"), digits_of(browser, r"0-9.\s")),
        "screen_width": width,
        "screen_height": height,
        "screen_ratio": ratio(width, height + 1),
        "device_name": last_match(device, DEVICE_RULES),
    })

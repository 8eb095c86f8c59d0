"""Settings of a wiki from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

SORT_KEYS = ("committed_date", "linked_count")
COLOR_SCHEMES = ("os_setting", "only_light", "only_dark")
# Two-letter language codes of ISO 639-1.
LANGUAGES = frozenset("""
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa
ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr
ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl
ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur
uz ve vi vo wa wo xh yi yo za zh zu
""".split())


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    title: str = ""
    base_url: str = ""
    lang_code: str = "en"
    timezone: str = "UTC"
    output_dir: str = "_site"
    build_search_index: bool = True
    sort_key: str = "committed_date"
    color_scheme: str = "os_setting"
    paginate_by: int | None = None
    stale_days: int | None = None
    extra: dict = field(default_factory=dict)


def load(path: str) -> Config:
    """Config of a file; a missing or malformed file or a bad value is an error."""
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    ssg, rules = raw.get("ssg", {}), raw.get("lint", {})
    known = {k: v for k, v in (raw | ssg).items() if k in Config.__dataclass_fields__ and k != "extra"}
    stale = rules.get("stale_by_git")
    if isinstance(stale, dict):
        known["stale_days"] = int(stale.get("threshold_days", 180))
    c = Config(**known, extra={k: v for k, v in raw.items() if k not in Config.__dataclass_fields__})
    if c.sort_key not in SORT_KEYS:
        raise ConfigError(f"unknown sort key {c.sort_key!r}")
    if c.paginate_by is not None and c.paginate_by < 1:
        raise ConfigError("paginate_by must be at least 1")
    if c.color_scheme not in COLOR_SCHEMES:
        raise ConfigError(f"unknown colour scheme {c.color_scheme!r}")
    if c.lang_code not in LANGUAGES:
        raise ConfigError(f"not a language code: {c.lang_code!r}")
    try:
        ZoneInfo(c.timezone)
    except Exception as e:
        raise ConfigError(f"unknown time zone {c.timezone!r}") from e
    return c


def wiki_dir(path: str | None = None) -> str:
    """Absolute folder of the wiki; it must exist."""
    full = os.path.abspath(path or os.getcwd())
    if not os.path.isdir(full):
        raise ConfigError(f"not a folder: {full}")
    return full


def init(folder: str, title: str = "My wiki") -> list[str]:
    """Write a config file and an ignore file where there is none; returns the paths written."""
    made = []
    for name, text in ((".notegrid.toml", f'title = "{title}"\ntimezone = "UTC"\n\n[ssg]\nbase_url = "https://example.com/"\n'), (".gitignore", "_site\n")):
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            made.append(path)
    return made

"""Settings of crawls and sinks; command line over script over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

FAIL, SKIP = "Fail", "SkipAndLog"
CREATE, APPEND, TRUNCATE = "create", "append", "truncate"


@dataclass(frozen=True)
class Throttle:
    """``kind``: Concurrent (downloads at once), PerSecond (starts a second) or Delay (seconds between them)."""

    kind: str = "Concurrent"
    value: float = 100

    def __post_init__(self):
        if self.kind not in ("Concurrent", "PerSecond", "Delay"):
            raise ValueError(f"unknown throttle {self.kind!r}")
        if self.value <= 0:
            raise ValueError("a throttle must be above 0")


@dataclass(frozen=True)
class CrawlerConfig:
    user_agent: str = "pagequarry-bot"
    page_buffer: int = 10_000
    throttle: Throttle | None = None
    num_workers: int = field(default_factory=lambda: max(1, (os.cpu_count() or 1) - 2))
    on_dl_error: str = SKIP
    on_xml_error: str = SKIP
    on_scrap_error: str = SKIP
    robot: str | None = None

    def __post_init__(self):
        for name in ("on_dl_error", "on_xml_error", "on_scrap_error"):
            if getattr(self, name) not in (FAIL, SKIP):
                raise ValueError(f"{name} must be {FAIL} or {SKIP}")

    def effective_throttle(self, robots_delay: float | None = None) -> Throttle:
        """An explicit one, else the robots file's delay, else 100 downloads at once."""
        if self.throttle:
            return self.throttle
        return Throttle("Delay", robots_delay) if robots_delay and robots_delay > 0 else Throttle()


@dataclass(frozen=True)
class CsvConfig:
    """``escape`` None doubles quotes; ``terminator`` is CRLF or one character; ``width`` is the number of
    fields that every record must have unless ``flexible`` (None: that of the widest share is not guessed, all
    widths pass)."""

    delimiter: str = ","
    escape: str | None = None
    flexible: bool = False
    terminator: str = "\n"
    width: int | None = None

    def __post_init__(self):
        for name in ("delimiter", "escape"):
            value = getattr(self, name)
            if value is not None and (len(value) != 1 or not value.isascii()):
                raise ValueError(f"{name} must be one ASCII character")
        if self.terminator == "CRLF":
            object.__setattr__(self, "terminator", "\r\n")
        elif self.terminator != "\r\n" and len(self.terminator) != 1:
            raise ValueError("terminator must be CRLF or one character")


_KEYS = {"userAgent": "user_agent", "pageBuffer": "page_buffer", "numWorkers": "num_workers", "onDlError": "on_dl_error", "onXmlError": "on_xml_error", "onScrapError": "on_scrap_error"}


def merged(script: dict | None = None, command_line: dict | None = None) -> CrawlerConfig:
    """Later wins; None means not given; camelCase names are understood."""
    out = CrawlerConfig()
    known = {f.name for f in fields(CrawlerConfig)}
    for given in (script or {}, command_line or {}):
        own = {_KEYS.get(k, k): v for k, v in given.items() if v is not None}
        if bad := set(own) - known:
            raise ValueError(f"unknown settings: {sorted(bad)}")
        if isinstance(own.get("throttle"), dict):
            (kind, value), = own["throttle"].items()
            own["throttle"] = Throttle(kind, value)
        out = replace(out, **own)
    return out


def validate_seed(pages=None, sitemaps=None, robots=None, config: CrawlerConfig | None = None) -> tuple[str, list[str]]:
    """(kind, urls) of the one seed that is given."""
    given = [(k, [v] if isinstance(v, str) else list(v)) for k, v in (("pages", pages), ("sitemaps", sitemaps), ("robots", robots)) if v]
    if len(given) != 1:
        raise ValueError("exactly one of seed pages, seed sitemaps and a seed robots file must be given")
    if given[0][0] == "robots" and config is not None and config.robot:
        raise ValueError("a seed robots file and the robot setting exclude each other")
    return given[0]

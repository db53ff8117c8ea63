"""Settings of an audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit


@dataclass(frozen=True)
class AuditConfig:
    start_url: str = "https://site.example/"
    max_pages: int | None = None
    max_keywords: int = 500
    max_rankings: int = 100
    max_depth: int | None = 12
    max_urls_per_path: int = 2000
    exclude_paths: tuple[str, ...] = field(default_factory=tuple)
    exclude_archives: bool = False
    strip_tracking: bool = True
    external_depth: int = 1
    max_external_pages: int = 500
    concurrency: int = 2
    delay_ms: int = 0
    user_agent: str = "webgrain"
    page_speed: bool = False
    analyze_images: bool = True
    report_broken_links: bool = True
    analyze_schema: bool = True
    sitemap_only: bool = False

    def __post_init__(self):
        def check(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        check(urlsplit(self.start_url).scheme in ("http", "https"), "start_url must be an HTTP or HTTPS URL")
        check(self.max_pages is None or self.max_pages >= 1, "max_pages is None or at least 1")
        check(1 <= self.max_keywords <= 5000, "max_keywords is from 1 to 5000")
        check(0 <= self.max_rankings <= 100, "max_rankings is from 0 to 100")
        check(self.max_depth is None or 0 <= self.max_depth <= 50, "max_depth is None or from 0 to 50")
        check(self.max_urls_per_path >= 10, "max_urls_per_path is at least 10")
        check(0 <= self.external_depth <= 3, "external_depth is from 0 to 3")
        check(1 <= self.max_external_pages <= 5000, "max_external_pages is from 1 to 5000")
        check(self.concurrency >= 1, "concurrency is at least 1")
        check(self.delay_ms >= 0, "delay_ms is at least 0")

    @classmethod
    def clamped(cls, **given) -> AuditConfig:
        """Settings as an interface takes them: numbers beyond their bounds are brought within, 50 pages if not said."""
        between = {
            "delay_ms": (0, 2000),
            "max_depth": (0, 50),
            "max_urls_per_path": (10, 50_000),
            "max_keywords": (1, 5000),
            "max_rankings": (0, 100),
            "external_depth": (0, 3),
            "max_external_pages": (1, 5000)
        }
        bounded = {k: min(max(v, between[k][0]), between[k][1]) if k in between and v is not None else v for k, v in given.items()}
        return cls(**{"max_pages": 50, **bounded})

    @property
    def exhaustive(self) -> bool:
        return self.max_pages is None and not self.exclude_paths and self.max_depth is None

    def settings(self) -> dict:
        return asdict(self)

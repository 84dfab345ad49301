"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    max_file_bytes: int = 2 << 20
    max_doc_bytes: int = 50 << 20
    max_url_bytes: int = 10 << 20
    max_job_bytes: int = 5 << 20
    max_files: int = 200
    whole_read_bytes: int = 30_720
    concurrency: int = 3
    retries: int = 2
    daily_budget_usd: float = 1.0
    results_retention_days: int = 14
    results_max_mb: int = 500
    export_retention_days: int = 0
    timezone: str = "UTC"
    context_share: float = 0.4
    min_budget: int = 256
    overlap_lines: int = 5
    max_tokens: dict = field(default_factory=lambda: {"extract": 16_000, "schema": 8_000, "draft": 4_096, "edits": 4_096})
    price_cap: tuple[float, float] = (1.0, 4.0)
    min_context: int = 32_000
    min_max_out: int = 16_000


class InputError(ValueError):
    """An argument or a file that a job refuses."""


def chunk_budget(context: int, max_prompt: int | None, fixed: int, settings: Settings = Settings()) -> int:
    """Tokens of input that a chunk may carry beside the fixed part of the prompt."""
    budget = min(int(settings.context_share * context), max_prompt or context) - fixed
    if budget < settings.min_budget:
        raise InputError(f"{budget} tokens are left for input; at least {settings.min_budget} are needed")
    return budget

"""Scan parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from veilscan.rules import PROFILES, Rule, live_rules

# File types that can be turned into text.
MIME_EXTENSIONS: dict[str, str] = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "text/plain": ".txt",
    "application/vnd.google-apps.document": "text/plain",
    "application/vnd.google-apps.spreadsheet": "text/csv",
}
FOLDER_MIME = "application/vnd.google-apps.folder"


@dataclass(frozen=True)
class ScanParams:
    """What to look for and how to cut texts. The defaults are fixed values."""

    chunk_size: int = 10_000
    chunk_overlap: int = 200
    confidence_threshold: float = 0.4
    entities: tuple[str, ...] | None = None
    profile: str = "default"
    custom_rules: tuple[Rule, ...] = ()
    mime_types: tuple[str, ...] = field(default_factory=lambda: tuple(MIME_EXTENSIONS))
    folder_id: str = "root"
    scan_all_users: bool = False

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("need chunk_size >= 1 and 0 <= chunk_overlap < chunk_size")
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; known: {sorted(PROFILES)}")
        numbers = [r.number for r in self.all_rules]
        if len(set(numbers)) != len(numbers):
            raise ValueError("custom rule numbers must not repeat those of the profile")

    @property
    def step(self) -> int:
        return self.chunk_size - self.chunk_overlap

    @property
    def all_rules(self) -> Sequence[Rule]:
        return (*PROFILES[self.profile], *self.custom_rules)

    @property
    def rules(self) -> list[Rule]:
        chosen = [
            r for r in self.all_rules if self.entities is None or r.entity in self.entities
        ]
        return live_rules(chosen, self.confidence_threshold)

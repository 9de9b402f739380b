"""What a caller can set."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The defaults are those of the core analysis; MULTI_PAGE and TARGET_PAGE are the two modes' own.

    link_in_headings is accepted and has no effect. max_pages bounds the pages of a site where a caller wants that; None: all.
    """

    max_links_per_source: int = 5
    max_links_per_target: int = 10
    min_score: int = 7
    min_keyword_overlap: int = 2
    min_anchor_words: int = 2
    allow_single_word: bool = False
    custom_topics: tuple[str, ...] = ()
    min_paragraph_words: int = 10
    exclude_selectors: str = ""
    include_selectors: str = ""
    link_in_headings: bool = False
    max_phrase_words: int = 7
    max_pages: int | None = None
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()


CORE = Settings()
MULTI_PAGE = Settings(min_paragraph_words=15)
TARGET_PAGE = Settings(min_score=5, min_keyword_overlap=1)

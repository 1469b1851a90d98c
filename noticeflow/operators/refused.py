"""Stored pages that are a refusal notice instead of content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.chars import contains_any, text_or_empty

# Fixed values.
REFUSAL_WORDS = ("访问过于频繁", "稍后再试")
WIDE_REFUSAL_WORDS = REFUSAL_WORDS + ("验证码", "captcha", "人机验证")


def refused(text: Column, wide: bool = False) -> Column:
    if wide:
        return contains_any(F.lower(text_or_empty(text)), WIDE_REFUSAL_WORDS)
    return contains_any(text_or_empty(text), REFUSAL_WORDS)

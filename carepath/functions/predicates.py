"""Row filters shared by the serving and notes queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath import schemas as S


def valid_tier(tier: str | None) -> str | None:
    """Upper-cased tier if it is one of HIGH/MEDIUM/LOW; anything else means 'no filter'."""
    if tier is None:
        return None
    t = tier.upper()
    return t if t in S.TIERS else None


def filter_tier(df: DataFrame, tier: str | None, col: str = "risk_tier") -> DataFrame:
    t = valid_tier(tier)
    return df if t is None else df.filter(F.col(col) == F.lit(t))


def nonblank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"\S")


def question_nonempty(questions: DataFrame, col: str = "question") -> DataFrame:
    """Blank questions are rejected before any retrieval work."""
    return questions.filter(nonblank(col))

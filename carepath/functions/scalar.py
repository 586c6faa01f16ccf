"""Column expressions (all JVM-side, inside whole-stage codegen).

Each function returns a ``Column``; none of them touches data by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carepath import schemas as S


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ parsing
def safe_parse_date(x: str | Column) -> Column:
    """Text -> DATE; unparsable text becomes null instead of failing (ANSI-safe)."""
    return _c(x).try_cast("date")


def safe_parse_ts(x: str | Column) -> Column:
    """Text -> TIMESTAMP_NTZ; unparsable text becomes null."""
    return _c(x).try_cast("timestamp_ntz")


# ----------------------------------------------------------- day arithmetic
def micros_between(start: str | Column, end: str | Column) -> Column:
    """Exact integer microseconds from start to end, independent of the session time zone.

    Both sides are wall-clock TIMESTAMP_NTZ (dates read as midnight). Spark's
    ``timestamp_diff`` evaluates NTZ inputs in the session zone (a stay across
    a daylight-saving change gains or loses an hour), so the difference is
    taken as whole days between the dates plus the time-of-day difference.
    """
    s, e = _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz")
    days = F.datediff(e.cast("date"), s.cast("date")).cast("long")
    return days * F.lit(S.US_PER_DAY) + _time_of_day_us(e) - _time_of_day_us(s)


def _time_of_day_us(t: Column) -> Column:
    return (F.hour(t).cast("long") * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long"))


def days_from_micros(us: Column) -> Column:
    return us.cast("double") / F.lit(float(S.US_PER_DAY))


def stay_days(admit: str | Column = "admittime", disch: str | Column = "dischtime") -> Column:
    """Length of stay in (fractional) days."""
    return days_from_micros(micros_between(admit, disch))


def ts_literal(ts: str) -> Column:
    """A TIMESTAMP_NTZ literal (no session-time-zone dependence)."""
    return F.expr(f"TIMESTAMP_NTZ '{ts}'")


def days_since(last: str | Column, as_of: str) -> Column:
    """Days from ``last`` to the explicit ``as_of`` instant (replaces NOW())."""
    return days_from_micros(micros_between(last, ts_literal(as_of)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double"))


def flag(cond: Column) -> Column:
    """1 when cond is true, else 0 (null counts as false)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def age_years(first_admit: str | Column, dob: str | Column) -> Column:
    """Whole days from dob to first admission / 365.25, clipped to 0..90; null stays null."""
    days = F.floor(micros_between(dob, first_admit) / F.lit(S.US_PER_DAY))
    years = days.cast("double") / F.lit(S.DAYS_PER_YEAR)
    clipped = F.least(F.greatest(years, F.lit(0.0)), F.lit(float(S.AGE_CAP_YEARS)))
    # least/greatest skip nulls, so guard explicitly to keep missing ages missing
    return F.when(years.isNotNull(), clipped)


def encode_gender(g: str | Column = "gender") -> Column:
    return flag(_c(g) == F.lit("M"))


def clean_code(code: str | Column = "icd9_code") -> Column:
    return F.regexp_replace(_c(code).cast("string"), r"^\s+|\s+$", "")


def default_recency(c: str | Column = "days_since_last_admission") -> Column:
    return F.coalesce(_c(c), F.lit(-1.0))


def default_zero(c: str | Column) -> Column:
    return F.coalesce(_c(c), F.lit(0))


def stable(x: str | Column, digits: int = 9) -> Column:
    """Round a floating sum to ``digits`` places. Sums of doubles depend on the order rows
    arrive in; rounding far below the data's precision makes equal-in-exact-arithmetic
    values (duplicate documents, tied scores) compare equal, so ties resolve by key."""
    return F.round(_c(x), digits)


# ------------------------------------------------------------- score bands
def risk_tier(score: str | Column = "risk_score") -> Column:
    """Right-closed bins (0,.3] LOW, (.3,.6] MEDIUM, (.6,1] HIGH; outside -> null."""
    s = _c(score)
    expr = None
    for lo, hi, name in S.TIER_EDGES:
        cond = (s > F.lit(lo)) & (s <= F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def risk_band(score: str | Column = "risk_score") -> Column:
    """Display band of the dashboard (differs from risk_tier)."""
    s = _c(score)
    return F.when(s >= 0.7, F.lit("HIGH")).when(s >= 0.4, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def score_bucket(score: str | Column = "risk_score") -> Column:
    """Histogram bucket 0..9 of a score in [0, 1]."""
    return F.least(F.floor(_c(score) * 10), F.lit(9)).cast("int")


# -------------------------------------------------------------- formatting
_SPLIT = 134217729.0   # 2^27 + 1, Dekker's splitting constant


def _split(a: Column) -> tuple[Column, Column]:
    t = a * F.lit(_SPLIT)
    hi = t - (t - a)
    return hi, a - hi


def round_half_even_exact(x: str | Column, digits: int) -> Column:
    """Round half-even on the *exact* binary value of a double, as Python's format does.

    ``x * 10^d`` is rounded when computed; its exact error comes from Dekker's
    error-free product (plain double arithmetic, JVM-side), so 2.675 (stored
    just below) rounds down and 82.825 (stored just above) rounds up, and only
    true binary ties such as 0.125 go to even. Exact for |x * 10^d| < 2^52.
    A negative value that rounds to zero keeps its sign, as Python prints -0.00.
    """
    return _rounded(x, digits, lambda r, err: (err > 0) | ((err == 0) & (F.pmod(r, F.lit(2.0)) == 1)))


def round_half_up_exact(x: str | Column, digits: int) -> Column:
    """Round half away from zero on the *exact* binary value, as a browser's toFixed does: 0.25 gives 0.3,
    1.005 (stored just below) gives 1.00."""
    return _rounded(x, digits, lambda r, err: err >= 0)


def _rounded(x: str | Column, digits: int, tie_up) -> Column:
    """``x`` to ``digits`` places; ``tie_up(whole, err)`` decides where ``x * 10^d`` computes to a half and is off by ``err``."""
    v = _c(x).cast("double")
    s = F.abs(v)
    b = float(10 ** digits)
    p = s * F.lit(b)
    vh, vl = _split(s)
    bh, bl = _split(F.lit(b))
    err = ((vh * bh - p) + vh * bl + vl * bh) + vl * bl
    r = F.floor(p).cast("double")
    f = p - r
    k = F.when((f > 0.5) | ((f == 0.5) & tie_up(r, err)), r + 1).otherwise(r) / F.lit(b)
    return F.when(v < 0, -k).otherwise(k)


def fmt_fixed(x: str | Column, digits: int, sign: bool = False) -> Column:
    """Fixed-point text exactly as Python's ``f"{x:.{digits}f}"`` (``+`` flag optional)."""
    pattern = f"%{'+' if sign else ''}.{digits}f"
    return F.format_string(pattern, round_half_even_exact(x, digits))


def fmt_browser(x: str | Column, digits: int) -> Column:
    """Fixed-point text as a browser's ``x.toFixed(digits)``."""
    return F.format_string(f"%.{digits}f", round_half_up_exact(x, digits))


def fmt_percent(x: str | Column, digits: int = 1) -> Column:
    """Python-style ``{:.1%}``: value * 100, fixed digits, then '%'."""
    return F.concat(fmt_fixed(_c(x).cast("double") * F.lit(100.0), digits), F.lit("%"))


def driver_name(feature: str | Column) -> Column:
    """shap_days_since_last_admission -> 'Days Since Last Admission'."""
    return F.initcap(F.regexp_replace(F.regexp_replace(_c(feature), "^shap_", ""), "_", " "))


def driver_key(feature: str | Column) -> Column:
    """shap_x -> x."""
    return F.regexp_replace(_c(feature), "^shap_", "")


def driver_direction(v: str | Column, up: str = "increases", down: str = "decreases") -> Column:
    """Positive attribution raises risk; zero and negative read as the down word."""
    return F.when(_c(v) > 0, F.lit(up)).otherwise(F.lit(down))


def ward_context(ward: str | Column = "predicted_ward") -> Column:
    """Ward -> description; unknown or missing ward -> 'General Ward'."""
    m = F.create_map(*[x for k, v in S.WARD_CONTEXT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(ward)), F.lit(S.WARD_CONTEXT_DEFAULT))


def clean_report_text(t: str | Column, markers: bool = True) -> Column:
    """Turn newlines into <br/> for the report layout and strip bold ``markers`` (the explanation keeps them)."""
    c = F.replace(_c(t), F.lit("**"), F.lit("")) if markers else _c(t)
    return F.replace(c, F.lit("\n"), F.lit("<br/>"))


def round_confidence(prob: str | Column) -> Column:
    """Largest of an array of class probabilities, rounded to 3 places as numpy does (half-even on the product)."""
    return F.rint(F.array_max(_c(prob)) * 1000) / 1000

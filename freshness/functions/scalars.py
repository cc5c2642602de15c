"""Column functions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MARK = "\u0001"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(value: str | Column, low: float, high: float) -> Column:
    """Bound a value to [low, high]."""
    return F.least(F.greatest(_col(value), F.lit(low)), F.lit(high))


def dot(u: str | Column, v: str | Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(_col(u), _col(v), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def dot_fixed(u: str | Column, v: str | Column, size: int) -> Column:
    """Inner product of the first `size` values, unrolled so that it compiles into the stage."""
    u, v = _col(u), _col(v)
    total = F.lit(0.0)
    for i in range(size):
        total = total + F.get(u, F.lit(i)) * F.get(v, F.lit(i))
    return total


def biased_rating(user: str | Column, item: str | Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Rating predicted from vectors whose last slot is a bias."""
    user, item = _col(user), _col(item)
    factors = F.size(user) - 1
    inner = dot(F.slice(user, F.lit(1), factors), F.slice(item, F.lit(1), factors))
    return clip(inner + F.element_at(user, -1) + F.element_at(item, -1), low, high)


def parse_vector(text: str | Column) -> Column:
    """A list literal such as '[1.0, 2.5]' as an array."""
    return F.from_json(_col(text), "array<double>")


def steps_between(t, t0, step=1) -> Column:
    """Whole steps from t0 to t, toward zero."""
    return ((_col(t) - _col(t0)) / F.lit(step)).cast("long")


def seasonal_at(season, t, t0, step=1) -> Column:
    """Value of a repeating profile at time t, for a model made at t0."""
    season = _col(season)
    return F.get(season, F.pmod(steps_between(t, t0, step), F.size(season)).cast("int"))


def residual(value, trend, season, t, t0, step=1) -> Column:
    """What is left of a reading after trend and season."""
    return _col(value) - _col(trend) - seasonal_at(season, t, t0, step)


def forecast_at(forecast, t, t0) -> Column:
    """The stored forecast for time t; null outside the horizon."""
    ahead = (_col(t) - _col(t0)).cast("int")
    return F.when(ahead >= 0, F.get(_col(forecast), ahead))


def error_cols(y, p) -> dict[str, Column]:
    """Difference, absolute, squared and root error."""
    d = _col(p) - _col(y)
    return {"diff": d, "abs_error": F.abs(d), "sq_error": d * d, "root_error": F.sqrt(F.abs(d))}


def epoch_to_time(seconds) -> Column:
    """Epoch seconds as a timestamp."""
    return F.timestamp_seconds(_col(seconds))


def parse_iso(text) -> Column:
    """ISO-8601 text as a timestamp."""
    return F.to_timestamp(_col(text))


def minute_index(ts, epoch: str) -> Column:
    """Whole minutes since `epoch`; null before it."""
    seconds = seconds_since(ts, epoch)
    return F.when(seconds >= 0, F.floor(seconds / 60).cast("long"))


def seconds_since(ts, epoch: str) -> Column:
    """Seconds (with fraction) from a fixed wall-clock moment to a zone-less timestamp."""
    start = F.lit(epoch).cast("timestamp_ntz")
    return (F.unix_micros(_col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def revision_ids(name) -> list[Column]:
    """The two ids of a file name of the form new_old.json."""
    parts = F.split(F.regexp_replace(_col(name), r"\.json$", ""), "_")
    return [F.get(parts, F.lit(0)).cast("long").alias("revid"), F.get(parts, F.lit(1)).cast("long").alias("old_revid")]


def safe_title(title) -> Column:
    """A title that can be a file name: spaces and slashes become dashes."""
    return F.translate(_col(title), " /", "--")


def split_sentences(text) -> Column:
    """Sentences in order, separators kept, so that joining them gives the text back."""
    marked = F.replace(_col(text), F.lit(".\n"), F.lit(".\n" + _MARK))
    marked = F.replace(marked, F.lit(". "), F.lit(". " + _MARK))
    return F.split(marked, _MARK)


def with_value(value: Column, body) -> Column:
    """`body` applied to `value`, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentence_offsets(sentences) -> Column:
    """Start position of each sentence in the joined text."""

    def starts(s: Column) -> Column:
        walked = F.aggregate(
            s,
            F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.concat(acc["starts"], F.array(acc["at"] + F.length(x))).alias("starts"),
                (acc["at"] + F.length(x)).alias("at"),
            ),
        )
        return F.slice(walked["starts"], F.lit(1), F.size(s))

    return with_value(_col(sentences), starts)


def has_alnum(s) -> Column:
    """Any ASCII letter or digit."""
    return _col(s).rlike("[a-zA-Z0-9]")


def passage_arrays(sentences, n: int = 10, separator: str = " ") -> Column:
    """Sentence list to passage list: each n sentences joined by the separator."""

    def blocks(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(n))
        joined = F.transform(starts, lambda at: F.array_join(F.slice(s, at, F.lit(n)), separator))
        return F.when(F.size(s) > 0, joined).otherwise(F.array().cast("array<string>"))

    return with_value(_col(sentences), blocks)


def contains_answer(passages, answer) -> Column:
    """Whether any passage of the list holds the answer."""
    answer = _col(answer)
    return F.exists(_col(passages), lambda p: F.contains(p, answer))


def weighted_avg(value, weight) -> Column:
    """Aggregate: sum of value x weight over sum of weight; null when the weight is 0."""
    value, weight = _col(value), _col(weight)
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))

"""Document classes recognised by keywords."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import fixed2, labels_where
from packetloom.operators.detector import Columns, Detector, register

# Matching ignores case, and \b, \d, \s follow Unicode.
_FLAGS = "(?iU)"


def bucket_hits(low: Column) -> Columns:
    """Number of matching patterns per keyword bucket of a lower-case text.

    A regex runs only on texts that contain a literal part of it.
    """
    hits = {}
    for i, ((_, patterns), guards) in enumerate(zip(fv.KEYWORD_BUCKETS, fv.KEYWORD_GUARDS)):
        tests = [(F.contains(low, F.lit(guard)) & F.rlike(low, F.lit(_FLAGS + regex))).cast("int")
                 for regex, guard in zip(patterns, guards)]
        hits[f"h{i}"] = reduce(add, tests)
    return hits


def bucket_score(hits: Column) -> Column:
    return F.when(hits > 0, F.least(F.lit(fv.KEYWORD_CAP), F.lit(fv.KEYWORD_BASE) + F.lit(fv.KEYWORD_STEP) * (hits - 1))).otherwise(0.0)


def best_hits(**hits: Column) -> Column:
    """Hits of the best bucket; more hits never score less."""
    return F.greatest(*hits.values())


def best_label(**hits: Column) -> Column:
    """Label of the first bucket with the highest score, null without hits."""
    best = bucket_score(best_hits(**hits))
    return F.coalesce(*[F.when((count > 0) & (bucket_score(count) == best), F.lit(label))
                        for count, (label, _) in zip(hits.values(), fv.KEYWORD_BUCKETS)])


def _score(**hits: Column) -> Column:
    return F.when(best_label(**hits).isin(*fv.SENSITIVE_DOCUMENT_CLASSES), bucket_score(best_hits(**hits))).otherwise(0.0)


def _findings(**hits: Column) -> Column:
    label = best_label(**hits)
    per_bucket = [(count > 0, F.concat(F.lit(f"Keyword bucket '{name}' matched "), count.cast("string"), F.lit(" pattern(s)")))
                  for count, (name, _) in zip(hits.values(), fv.KEYWORD_BUCKETS)]
    chosen = F.concat(F.lit("Sensitive content (keywords): "), label, F.lit(" ("), fixed2(bucket_score(best_hits(**hits))), F.lit(")"))
    return labels_where(*per_bucket, (label.isin(*fv.SENSITIVE_DOCUMENT_CLASSES), chosen))


content = register(Detector("content", _score, _findings, bucket_hits, lambda input: {"low": F.lower(input)}))

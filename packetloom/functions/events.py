"""Column functions over verdicts, log rows and uploads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import strip


def normal_status(status: Column) -> Column:
    """``block`` if the text is ``block`` in any case, else ``allow``."""
    return F.when(F.lower(status) == "block", "block").otherwise("allow")


def log_level(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low == "block", "BLOCK").when(low == "censor", "WARN").otherwise("ALLOW")


def short_msg(reason: Column, length: int = 100) -> Column:
    return F.substring(strip(F.coalesce(reason, F.lit(""))), 1, length)


def classify_threat(reason: Column) -> Column:
    """Struct (type, severity, confidence) of the first label in the reason."""
    low = F.lower(reason)

    def label(kind: str, severity: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                        F.lit(confidence).alias("confidence"))

    chain = F
    for word, *rest in fv.THREAT_LABELS:
        chain = chain.when(F.contains(low, F.lit(word)), label(*rest))
    return chain.otherwise(label(*fv.THREAT_DEFAULT))


def source_region(ip: Column) -> Column:
    """LAN, ?? or a placeholder region drawn from the first number."""
    lan = F.lit(False)
    for prefix in fv.LAN_PREFIXES:
        lan = lan | F.startswith(ip, F.lit(prefix))
    first = F.substring_index(ip, ".", 1).try_cast("int")
    region = F.get(F.array(*[F.lit(code) for code in fv.REGION_BUCKETS]),
                   F.pmod(first, F.lit(len(fv.REGION_BUCKETS))))
    return F.when(ip.isNull() | ip.isin("", "unknown"), "??").when(lan, "LAN").otherwise(F.coalesce(region, F.lit("??")))


def upload_size(size_bytes: Column) -> Column:
    """One decimal of MB above 1 MiB, whole KB below, ties to even."""
    kib, mib = 1024, 1024 * 1024
    return F.when(size_bytes > mib, F.concat(F.format_string("%.1f", F.bround(size_bytes / F.lit(float(mib)), 1)), F.lit(" MB"))) \
        .otherwise(F.concat(F.bround(size_bytes / F.lit(float(kib)), 0).cast("long").cast("string"), F.lit(" KB")))


def upload_type(name: Column, kind: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring(F.upper(F.substring_index(name, ".", -1)), 1, 4)).otherwise(kind)


def upload_status(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low == "block", "flagged").when(low == "allow", "indexed").otherwise("analyzing")


def upload_tags(risk_level: Column, reason: Column) -> Column:
    risk = F.concat(F.lit("risk="), risk_level)
    return F.when(F.coalesce(reason, F.lit("")) != "", F.array(risk, short_msg(reason, 60))).otherwise(F.array(risk))


def upload_kind(name: Column, mime: Column) -> Column:
    """Struct (kind, content_type) the intake page derives from a file."""
    extension = F.lower(F.substring_index(name, ".", -1))
    image = F.coalesce(F.startswith(mime, F.lit("image")), F.lit(False)) | extension.isin(*fv.UPLOAD_IMAGE_EXTENSIONS)
    other = F.substring(F.upper(F.when(extension == "", "DOC").otherwise(extension)), 1, 4)
    return F.struct(F.when(image, "IMG").otherwise(other).alias("kind"),
                    F.when(image, "image").otherwise("document").alias("content_type"))


def first_filled(*values: Column | str) -> Column:
    """First value that is neither null nor empty; the last is the default."""
    *tried, default = values
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in tried], F.lit(default) if isinstance(default, str) else default)

"""Secret scans with multipart credential linking, in Spark expressions only.

Strong spans stand alone: ``assign`` (a keyword, a separator, a value of 12 or
more), ``access`` (AKIA identifiers of 18 or more) and ``hex`` (runs of 16 or
more). Weak candidates - bare mixed strings, user identifiers and endpoints -
mean nothing alone. They are linked by an interval join of the parts of one
text on their starts: two parts share a scope when they begin at most ``scope``
code points apart. A weak secret is reported beside an identifier, an
identifier beside a secret, an endpoint where both lie in its scope. A secret is
an ``assign`` or weak string, or a ``hex`` run outside the part it stands beside.

The join runs over the parts sorted by start. Parts of a kind do not overlap
and are at least 8 long, so at most ``scope / 8`` of each kind begin within the
scope on either side: a window of that many neighbours holds every partner, and
the join is linear in the parts and needs no shuffle.

Defined results: a null or empty text has no spans; repeated rows are scanned
alike each time; an empty table gives an empty result; equal starts go by kind
as listed in ``KINDS``; extra columns are carried along (columns of the names
added here are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import quoted, shielded, table

KINDS = ("assign", "access", "hex", "endpoint", "identifier", "weak")
# The patterns of the strong kinds; a value's length is tested after the match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match of these two is a whole run, so asking for the length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z0-9]+|s3|redis|mongodb)://[^\x00-\x20"'<>]{2,}"""
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_id|account_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
MIN_VALUE = 12
MIN_PART = 8
#: Starts are summed up in runs of so many matches, so that the work stays linear.
RUN = 256
_SPAN = "struct<s:int,k:int,e:int>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(df: DataFrame, kind: str, pattern: str, gate: str = "true") -> DataFrame:
    """Adds ``_<kind>``: the spans of ``pattern`` in ``_t``, in order.

    The pieces between the matches and the matches themselves give the places.
    """
    k, p = KINDS.index(kind), _quoted(pattern)
    keep = f"length(regexp_extract(m, {p}, 2)) >= {MIN_VALUE}" if kind == "assign" else "true"
    df = df.withColumn("_m", F.expr(f"if({gate} and _t rlike {p}, regexp_extract_all(_t, {p}, 0), null)"))
    if kind == "assign":
        df = df.withColumn("_v", F.expr(f"if(_m is null, null, transform(regexp_extract_all(_t, {p}, 2), v -> length(v) >= {MIN_VALUE}))"))
        keep = "_v[i]"
    df = df.withColumn("_g", F.expr(f"if(_m is null, null, split(_t, {p}, -1))"))
    df = df.withColumn("_l", F.expr(
        f"transform(_m, (m, i) -> struct(length(_g[i]) as gap, length(m) as len, {keep} as keep))"
    ))
    df = df.withColumn("_l", F.expr(f"transform(sequence(0, (size(_l) - 1) div {RUN}), c -> slice(_l, cast(c * {RUN} as int) + 1, {RUN}))"))
    df = df.withColumn("_o", F.expr(
        "aggregate(_l, cast(array(0) as array<int>), (a, ch) -> array_append(a, element_at(a, -1) + aggregate(ch, 0, (s, x) -> s + x.gap + x.len)))"
    ))
    one = f"struct(acc.at + x.gap as s, {k} as k, acc.at + x.gap + x.len as e)"
    df = df.withColumn(f"_{kind}", F.expr(
        f"coalesce(flatten(transform(_l, (ch, c) -> aggregate(ch, struct(_o[c] as at, cast(array() as array<{_SPAN}>) as out), "
        f"(acc, x) -> struct(acc.at + x.gap + x.len as at, if(x.keep, array_append(acc.out, {one}), acc.out) as out)).out)), "
        f"cast(array() as array<{_SPAN}>))"
    ))
    return df.drop("_m", "_g", "_l", "_o", "_v")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """All columns of ``docs`` with ``base_spans`` and ``all_spans``: arrays of
    (s start, k index in KINDS, e end), in code points, end exclusive, sorted."""
    docs, back = shielded(docs.drop("base_spans", "all_spans"), ("text",), ("base_spans", "all_spans"))
    df = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    df = _spans(df, "assign", ASSIGN)
    df = _spans(df, "access", ACCESS)
    df = _spans(df, "hex", HEX)
    # No complementary pair without one of these, so the other patterns need no run.
    df = _spans(df, "weak", WEAK)
    df = _spans(df, "identifier", IDENTIFIER, "size(_weak) + size(_assign) + size(_hex) > 0")
    df = _spans(df, "endpoint", ENDPOINT, "size(_weak) + size(_assign) + size(_hex) > 0 and size(_identifier) + size(_access) > 0")
    df = df.withColumn("base_spans", F.sort_array(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_z", F.sort_array(F.concat("_assign", "_access", "_hex", "_endpoint", "_identifier", "_weak")))
    reach = len(KINDS) * (scope // MIN_PART + 1)
    kind = {k: i for i, k in enumerate(KINDS)}
    near = lambda *kinds: f"exists(slice(_z, greatest(1, i + 1 - {reach}), {2 * reach + 1}), q -> q.k in ({', '.join(str(kind[k]) for k in kinds)}) and abs(q.s - p.s) <= {scope})"
    # An assign that begins before the parts in reach is longer than the scope.
    df = df.withColumn("_long", F.expr(f"filter(_assign, q -> q.e - q.s > {scope})"))
    holds = "q.s <= p.s and p.s < q.e"
    inside = f"(exists(slice(_z, greatest(1, i + 1 - {reach}), {reach}), q -> q.k = {kind['assign']} and {holds}) or exists(_long, q -> {holds}))"
    hexed = near("hex").replace(") and abs", ") and (q.s < p.s or q.s >= p.e) and abs")
    secret = f"({near('assign', 'weak')} or {hexed})"
    linked = (
        f"case p.k when {kind['weak']} then {near('access', 'identifier')} and not {inside} "
        f"when {kind['identifier']} then {secret} "
        f"when {kind['endpoint']} then {near('access', 'identifier')} and {secret} else false end"
    )
    df = df.withColumn("_added", F.expr(
        f"if(size(_weak) + size(_identifier) + size(_endpoint) = 0, cast(array() as array<{_SPAN}>), "
        f"filter(transform(_z, (p, i) -> if({linked}, p, null)), x -> x is not null))"
    ))
    df = df.withColumn("all_spans", F.expr("if(size(_added) = 0, base_spans, sort_array(concat(base_spans, _added)))"))
    return back(df)


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')"


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span of ``all_spans`` in ``text`` by ``mark``; overlapping spans become one."""
    # (at: end of what is written, out: text so far); a span that begins before ``at`` only moves it.
    step = (
        "struct(greatest(a.at, x.e) as at, if(x.s >= a.at, concat(a.out, substring(text, a.at + 1, x.s - a.at), '"
        + mark + "'), a.out) as out)"
    )
    done = f"aggregate(all_spans, struct(0 as at, '' as out), (a, x) -> {step}, a -> concat(a.out, substring(text, a.at + 1)))"
    return scanned.withColumn("text", F.expr(f"if(size(all_spans) = 0, text, {done})"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base_spans, x -> x.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}")
    return df.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.expr(f"sha2({_listed('base_spans')}, 256)").alias("base_sha256"), F.expr(_listed("all_spans")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its secrets redacted; n_chars follows the text."""
    return redact(scan(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))

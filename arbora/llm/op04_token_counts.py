"""Token counts by the whole-token shortcut.

Offline, the vocabulary is searched for strings that the merges turn into one
token (``whole_tokens``): a string whose parts merge otherwise does not count.
A text is cut into pre-tokens by the tokenizer's own rule; equal pre-tokens are
counted together, those proven whole count 1 each, and only the rest run
through the merges, each distinct one once for as long as a bounded memory
holds it.

Special strings inside a text are handled as the library does by default: they
are cut out first and count one token each. Defined results: a null or empty
text has no bytes and no tokens; repeated rows count alike; an empty table gives
an empty result; extra columns are carried along (columns of the names added
here are replaced). A tokenizer file with other rules (a normalizer, another
pre-tokenizer, added tokens that strip or normalize) is an error.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import shielded, table

# Fixed value: the byte-level pre-token pattern.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this code point are cut by the library itself: its tables of letters may be of another Unicode version.
PLAIN_LIMIT = 0x250
#: So many pre-tokens that are no whole token are remembered by a worker.
REMEMBERED = 200_000
#: So many rows of a batch are counted at a time.
ROWS = 64


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Vocabulary strings (in the byte alphabet) that encode alone as one token.

    A string of one symbol is whole. A longer one is whole exactly if applying
    the merges by rank to its symbols ends in itself; that is tried for every
    entry, so the table is proven and not assumed.
    """
    from tokenizers import models

    spec = json.loads(tokenizer_json)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    bpe = models.BPE(vocab=spec["vocab"], merges=merges)
    return frozenset(s for s in spec["vocab"] if len(bpe.tokenize(s)) == 1)


def check_supported(tokenizer_json: str) -> None:
    """Raises ValueError for a tokenizer whose rules are others than the ones that this module follows."""
    spec = json.loads(tokenizer_json)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model.get("type") != "BPE":
        odd.append("model")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        odd.append("pre_tokenizer")
    if odd:
        raise ValueError(f"only byte-level BPE without normalizer is supported; this tokenizer has another {', '.join(odd)}")


class TokenCounter:
    """Counts tokens of texts in one worker."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        from tokenizers import models, pre_tokenizers

        spec = json.loads(tokenizer_json)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.bpe = models.BPE(vocab=spec["model"]["vocab"], merges=merges)
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.latin = {i: alphabet[i] for i in range(256)}
        texts = (bytes(back[c] for c in s) for s in whole)
        self.whole = dict.fromkeys((t.decode() for t in texts if _is_text(t)), 1)
        self.rest: dict[str, int] = {}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRETOKEN)

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(PLAIN_LIMIT):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.cut.pre_tokenize_str(text)]

    def merged(self, pretoken: str) -> int:
        n = self.rest.get(pretoken)
        if n is None:
            n = len(self.bpe.tokenize(pretoken.encode().decode("latin-1").translate(self.latin)))
            if len(self.rest) >= REMEMBERED:
                self.rest.clear()
            if len(pretoken) <= 64:
                self.rest[pretoken] = n
        return n

    def count(self, text: str) -> int:
        parts, found = [text], 0
        if self.special is not None:
            parts = self.special.split(text)
            found = len(parts) - 1
        whole = self.whole
        for part in parts:
            if part:
                for pretoken, k in Counter(self.pretokens(part)).items():
                    found += k if pretoken in whole else k * self.merged(pretoken)
        return found


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


#: A worker's counter, kept between its tasks.
_workers: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """All columns but ``text`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    check_supported(tokenizer_json)
    # Bounded by the vocabulary, whatever the corpus.
    key = tokenizer_path
    shared = spark.sparkContext.broadcast((tokenizer_json, whole_tokens(tokenizer_json)))
    added = ("n_bytes", "n_tokens", "over_limit")
    docs, back = shielded(docs.drop(*added), ("text",), added)
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _workers:
            _workers.clear()
            _workers[key] = TokenCounter(*shared.value)
        counter = _workers[key]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                tokens = pa.array([counter.count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [sizes, tokens], [*kept, "n_bytes", "n_tokens"])

    out = docs.mapInArrow(run, schema)
    return back(out.withColumn("over_limit", F.col("n_tokens") > limit))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))

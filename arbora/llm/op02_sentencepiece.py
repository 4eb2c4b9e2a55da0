"""SentencePiece encoding and decoding with a unigram Viterbi search.

Pieces and their log scores come from a ``.model`` file and go into a
double-array trie over UTF-8 bytes. A text gets its whitespace marker, and the
segmentation of the highest summed score is found by dynamic programming; a
character that no piece covers costs 10 less than the worst piece and is spelled
as byte pieces. The text falls into units - markers with the letters, or the other
characters, behind them - that no piece reaches across (checked on load), so every
best segmentation ends a piece at their bounds: units are solved one by one, and
frequent units are remembered.
Sums are in double precision; of equal sums the one reached first in order of
the last piece's length, shortest start first, stays.

Decoding joins pieces, gathers byte pieces to UTF-8, turns markers to blanks and
drops the one that encoding put in front.

Defined results: a null or empty text has no pieces and decodes to the empty
text; U+2581, the marker itself, comes back as a blank; repeated rows encode
alike; an empty table gives an empty result; extra columns are carried along
(columns of the names added here are replaced).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import shielded, table

MARK = "▁"
# Fixed value: Latin letters as ranges of code points.
LATIN = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Units of a text: markers with Latin letters or with others behind them; or up to the next marker.
UNITS = (rf"{MARK}*[{LATIN}]+|{MARK}*[^0-9{MARK}{LATIN}]+|{MARK}*[0-9]|{MARK}+", rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: What a character without a piece costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: So many units are remembered by a worker, those up to UNIT_CHARS long.
REMEMBERED = 300_000
UNIT_CHARS = 48
#: Rows that are encoded at a time.
ROWS = 256
#: Units that are solved side by side.
LANES = 4096


class DoubleArray:
    """A trie in two integer arrays: from state s over code c to base[s] + c, if check there is s.

    Code 0 ends a key and leads to a leaf whose base is -1 - value; byte b has code b + 1.
    """

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b + 1, {})
            node[0] = value
        base, check, free, queue = [0], [0], 1, [(0, root)]
        for state, node in queue:
            codes = sorted(node)
            while free < len(check) and check[free] >= 0:
                free += 1
            at = max(1, free - codes[0])
            while any(at + c < len(check) and check[at + c] >= 0 for c in codes):
                at += 1
            short = at + codes[-1] + 1 - len(check)
            if short > 0:
                base.extend([0] * short)
                check.extend([-1] * short)
            base[state] = at
            for c in codes:
                check[at + c] = state
                if c == 0:
                    base[at] = -1 - node[0]
                else:
                    queue.append((at + c, node[c]))
        # A transition from the last states may look this far past the end.
        base.extend([0] * 258)
        check.extend([-1] * 258)
        self.base, self.check = array("i", base), array("i", check)


class Model:
    """Pieces, scores and rules of a model file, ready to be sent to workers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        p = SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        spec.ParseFromString(p.serialized_model_proto())
        rule = spec.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalizer and kept white space can be decoded exactly")
        self.prefix = rule.add_dummy_prefix
        self.pieces = [p.id_to_piece(i) for i in range(p.vocab_size())]
        self.unknown = p.unk_id()
        self.bytes = {int(x[3:5], 16): i for i, x in enumerate(self.pieces) if p.is_byte(i)}
        normal = [i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        # The finest units that no piece reaches across.
        self.units = next((u for u in UNITS if all(len(re.findall(u, self.pieces[i])) == 1 for i in normal)), None)
        if self.units is None:
            raise ValueError("a piece holds a marker behind another character")
        self.scores = array("d", (p.get_score(i) for i in range(p.vocab_size())))
        self.worst = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        trie = DoubleArray({self.pieces[i].encode(): i for i in normal})
        self.base, self.check = trie.base, trie.check
        self.control = {i for i in range(p.vocab_size()) if p.is_control(i)}


class Codec:
    """Encodes and decodes in one worker; ``model`` is a Model's fields."""

    def __init__(self, model: dict):
        import numpy as np

        self.m = SimpleNamespace(**model)
        self.base, self.check, self.scores = self.m.base.tolist(), self.m.check.tolist(), self.m.scores.tolist()
        self.known: dict[str, bytes] = {}
        self.units = re.compile(self.m.units)
        self.byte_of = {i: b for b, i in self.m.bytes.items()}
        self.spelt = [p.replace(MARK, " ").encode() for p in self.m.pieces]
        for i, b in self.byte_of.items():
            self.spelt[i] = bytes([b])
        for i in self.m.control:
            self.spelt[i] = b""
        self.spelt[self.m.unknown] = " ⁇ ".encode()
        self.base_np, self.check_np = (np.frombuffer(x, np.int32).astype(np.int64) for x in (self.m.base, self.m.check))
        self.scores_np = np.frombuffer(self.m.scores, np.float64)

    def viterbi(self, unit: str) -> tuple[int, ...]:
        raw, base, check, scores = unit.encode(), self.base, self.check, self.scores
        n = len(raw)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, k, single = best[at], 0, at, False
            while k < n:
                b = base[state]
                t = b + raw[k] + 1
                if check[t] != state:
                    break
                state = t
                k += 1
                leaf = base[state]
                if check[leaf] == state and base[leaf] < 0:
                    v = -1 - base[leaf]
                    s = here + scores[v]
                    if s > best[k]:
                        best[k], back[k], piece[k] = s, at, v
                    single = single or k - at == width
            if not single and here + self.m.worst > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = here + self.m.worst, at, -2
            at += width
        return self.trace(raw, back, piece)

    def solve(self, units: list[str]) -> None:
        """Viterbi for many units side by side; what is found goes into ``known``.

        All units of a length class take each step together: position by
        position, the states of all walks from it move on by one byte until
        none is left. Sums are compared as in ``viterbi``, in the same order.
        """
        import numpy as np

        base, check, scores = self.base_np, self.check_np, self.scores_np
        raws = [u.encode() for u in units]
        sizes = np.array([len(r) for r in raws], np.int64)
        order = np.argsort(sizes, kind="stable")
        for first in range(0, len(order), LANES):
            chosen = order[first:first + LANES]
            n, size = len(chosen), sizes[chosen]
            wide = int(size[-1])
            pitch = wide + 4
            text = np.frombuffer(b"".join([raws[i].ljust(pitch, b"\0") for i in chosen]), np.uint8).astype(np.int64)
            # All tables are flat: lane r's place k is r * pitch + k.
            best = np.full(n * pitch, -np.inf)
            back, piece = np.zeros(n * pitch, np.int64), np.full(n * pitch, -1, np.int64)
            lane = np.arange(n, dtype=np.int64) * pitch
            best[lane] = 0.0
            for at in range(wide):
                lead = text[lane + at]
                rows = np.flatnonzero((at < size) & ((lead & 0xC0) != 0x80))
                if not len(rows):
                    continue
                lead, here, begin, stop = lead[rows], best[lane[rows] + at], lane[rows], lane[rows] + size[rows]
                width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                single = np.zeros(len(rows), bool)
                walk, spot, state = np.arange(len(rows)), begin + at, np.zeros(len(rows), np.int64)
                step = 0
                while len(walk):
                    to = base[state] + text[spot] + 1
                    on = (check[to] == state) & (spot < stop[walk])
                    walk, spot, state = walk[on], spot[on] + 1, to[on]
                    step += 1
                    leaf = base[state]
                    ends = np.flatnonzero(check[leaf] == state)
                    if len(ends):
                        v = -1 - base[leaf[ends]]
                        ends, v = ends[v >= 0], v[v >= 0]
                        w = walk[ends]
                        s, k = here[w] + scores[v], spot[ends]
                        better = s > best[k]
                        k = k[better]
                        best[k], back[k], piece[k] = s[better], at, v[better]
                        single[w[width[w] == step]] = True
                bare = np.flatnonzero(~single)
                k, cost = begin[bare] + at + width[bare], here[bare] + self.m.worst
                better = cost > best[k]
                best[k[better]], back[k[better]], piece[k[better]] = cost[better], at, -2
            # Walk back in step; the last piece comes first, so rows fill from their end.
            ids, fill = np.zeros((n, wide), np.int32), np.full(n, wide)
            rows, k = np.arange(n), size.copy()
            odd = np.zeros(n, bool)
            while len(rows):
                got = piece[lane[rows] + k]
                odd[rows] |= got < 0
                fill[rows] -= 1
                ids[rows, fill[rows]] = got
                k = back[lane[rows] + k]
                rows, k = rows[k > 0], k[k > 0]
            raw_ids, begin = ids.tobytes(), (np.arange(n) * wide + fill) * 4
            known = self.known
            for i, a, z in zip(chosen.tolist(), begin.tolist(), ((np.arange(n) + 1) * wide * 4).tolist(), strict=True):
                known[units[i]] = raw_ids[a:z]
            for row in np.flatnonzero(odd):
                at, i = row * pitch, chosen[row]
                known[units[i]] = _packed(self.trace(raws[i], back[at:at + pitch].tolist(), piece[at:at + pitch].tolist()))

    def trace(self, raw: bytes, back, piece) -> tuple[int, ...]:
        out, k = [], len(raw)
        while k > 0:
            if piece[k] == -2:
                if self.m.bytes:
                    out.extend(self.m.bytes[b] for b in reversed(raw[back[k]:k]))
                else:
                    out.append(self.m.unknown)
            else:
                out.append(piece[k])
            k = back[k]
        return tuple(reversed(out))

    def encode_all(self, texts: list[str]) -> list:
        """Ids of each text as an int32 array; units that are not remembered are solved together."""
        import numpy as np

        front = " " if self.m.prefix else ""
        split = [self.units.findall((front + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = {u for units in split for u in units if u not in known}
        self.solve([u for u in new if len(u) <= UNIT_CHARS])
        long = [u for u in new if len(u) > UNIT_CHARS]
        for u in long:
            known[u] = _packed(self.viterbi(u))
        out = [np.frombuffer(b"".join([known[u] for u in units]), np.int32) for units in split]
        for u in long:
            del known[u]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        # Pieces are whole characters, so byte pieces between them decode in place.
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def _packed(ids: tuple[int, ...]) -> bytes:
    return array("i", ids).tobytes()


#: A worker's codec, kept between its tasks.
_workers: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    if key not in _workers:
        _workers.clear()
        _workers[key] = Codec(shared.value)
    return _workers[key]


def encode(docs: DataFrame, model_path: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, n_pieces and n_fallback (byte pieces of characters without a piece)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(Model(model_path)))  # bounded by the vocabulary
    added = ("ids", "n_pieces", "n_fallback")
    docs, back = shielded(docs.drop(*added), ("text",), added)
    kept = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("n_fallback", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = _codec(model_path, shared)
        spelled = np.zeros(len(codec.m.pieces), bool)
        spelled[list(codec.byte_of)] = True
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows = codec.encode_all([t or "" for t in part.column(at).to_pylist()])
                sizes = np.array([len(r) for r in rows], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(rows)))
                spelt = pa.array([int(spelled[r].sum()) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [ids, pa.array(sizes), spelt], [*kept, "ids", "n_pieces", "n_fallback"])

    return back(docs.mapInArrow(run, schema))


def decode(encoded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """``encoded`` without ``ids`` but with the text that they spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(Model(model_path)))
    encoded, back = shielded(encoded.drop(column), ("ids",), (column,))
    kept = [c for c in encoded.columns if c != "ids"]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(column, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(model_path, shared)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts = pa.array([codec.decode(x or []) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [texts], [*kept, column])

    return back(encoded.mapInArrow(run, schema))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    got = got.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
    back = decode(got, path)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return back.select("doc_id", "n_pieces", "n_fallback", "ids_sha256", (F.col("decoded") == plain).alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each document as piece ids instead of text."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)

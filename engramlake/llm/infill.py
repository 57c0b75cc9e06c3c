"""Fill-in-middle transformation with a piecewise-linear learned rank index over token boundaries.

A text is cut into tokens (leading white space with a word, or white space alone); the boundary of rank r is the number
of code points in the first r tokens. The index of a text learns rank -> boundary as straight segments: a segment starts
at a boundary and grows while one slope keeps every boundary within ``ERROR`` code points (shrinking cone). The rounded
error of every rank is stored as one signed byte, so prediction plus residual is exact. The two cuts of a document are
drawn as ranks, predicted by their segments and corrected by their residuals.

All work is row by row in Arrow batches: no shuffle, and a task holds one text with its index at a time. The index can
also be kept as a table (``index_table``), from which ``cut_by_index`` answers other draws without reading the texts.

Defined cases: a null text counts as empty and stays plain with n = 0; a null id draws as the empty string; repeated rows
keep one row each, with equal draws; an empty table gives no rows; a text that holds one of the three marks stays plain;
columns other than ``doc_id`` and ``text`` pass through ``transform`` unchanged, and its own two columns may be renamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from engramlake.llm.common import ship

P, S, M = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
ERROR, WINDOW = 100, 1024


def boundaries(text: str) -> np.ndarray:
    """Code points before each token boundary, rank 0 first."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(a):
        return np.zeros(1, np.int64)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate([[0], ends, [len(a)]]).astype(np.int64)


class RankIndex:
    """Segments (first rank, boundary there, slope) and one residual per rank."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residual: np.ndarray):
        self.first, self.base, self.slope, self.residual = first, base, slope, residual

    @classmethod
    def fit(cls, b: np.ndarray) -> RankIndex:
        first, slope, residual = [], [], np.zeros(len(b), np.int8)
        at = 0
        while at < len(b):
            low, high, end, width = -np.inf, np.inf, at + 1, WINDOW
            while end < len(b):
                # Slopes that keep the ranks up to here within the error: the cone only narrows.
                rank = np.arange(end, min(end + width, len(b))) - at
                rise = b[end : end + width] - b[at]
                lows = np.maximum(np.maximum.accumulate((rise - ERROR) / rank), low)
                highs = np.minimum(np.minimum.accumulate((rise + ERROR) / rank), high)
                out = np.flatnonzero(lows > highs)
                n = out[0] if len(out) else len(rank)
                if n:
                    low, high = lows[n - 1], highs[n - 1]
                end += n
                if len(out):
                    break
                width *= 2
            s = (low + high) / 2 if end > at + 1 else 0.0
            first.append(at)
            slope.append(s)
            residual[at:end] = b[at:end] - np.rint(b[at] + s * np.arange(end - at)).astype(np.int64)
            at = end
        first = np.array(first, np.int64)
        return cls(first, b[first], np.array(slope), residual)

    def boundary(self, rank: int) -> int:
        """Exact boundary of a rank: prediction of its segment and the stored residual."""
        i = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(np.rint(self.base[i] + self.slope[i] * (rank - int(self.first[i])))) + int(self.residual[rank])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned integers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(doc_id: int | None, n: int, index: RankIndex, seed: int = SEED) -> tuple[int, int]:
    """Code points before the two cuts of a document of n tokens."""
    h1, h2, _, _ = draws(doc_id, seed)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return index.boundary(a), index.boundary(b)


def arrange(text: str, doc_id: int | None, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the transformed text."""
    b = boundaries(text)
    n = len(b) - 1
    _, _, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (P, S, M)) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    x, y = cut(doc_id, n, RankIndex.fit(b), seed)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < spm:
        return n, "spm", x, y - x, S + suffix + P + prefix + M + middle
    return n, "psm", x, y - x, P + prefix + S + suffix + M + middle


def restore(output: str, form: str) -> str:
    """The text that was transformed."""
    if form == "plain":
        return output
    if form == "spm":
        rest, middle = output[len(S) :].split(M)
        suffix, prefix = rest.split(P)
    else:
        rest, middle = output[len(P) :].split(M)
        prefix, suffix = rest.split(S)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the transformed and of the restored text."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, form, x, m, out = arrange(t.as_py() or "", i, seed, fim, spm)
                rows.append((i, n, form, x, m, _sha(out), _sha(restore(out, form))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def transform(docs: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, text_as: str = "fim_text", form_as: str = "fim_form") -> DataFrame:
    """Every row of ``docs`` as it was, with its transformed text and form as two further columns of the given names."""
    ship(docs.sparkSession)
    clash = {text_as.lower(), form_as.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken; give other names")
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = StructType([*docs.schema.fields, StructField(text_as, StringType()), StructField(form_as, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [arrange(t.as_py() or "", i, seed, fim, spm) for i, t in zip(b.column(key).to_pylist(), b.column(at), strict=True)]
            yield pa.record_batch([*b.columns, pa.array([g[4] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*b.schema.names, text_as, form_as])

    return docs.mapInArrow(run, schema)


INDEX_SCHEMA = "doc_id long, n long, first array<long>, base array<long>, slope array<double>, residual binary"


def index_table(docs: DataFrame) -> DataFrame:
    """The rank index of every text: about one byte a token and 24 bytes a segment."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [RankIndex.fit(boundaries(t.as_py() or "")) for t in b.column(1)]
            cols = [b.column(0), pa.array([len(x.residual) - 1 for x in found], pa.int64()), pa.array([x.first for x in found], pa.list_(pa.int64())), pa.array([x.base for x in found], pa.list_(pa.int64()))]
            cols += [pa.array([x.slope for x in found], pa.list_(pa.float64())), pa.array([x.residual.tobytes() for x in found], pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n", "first", "base", "slope", "residual"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX_SCHEMA)


def cut_by_index(index: DataFrame, seed: int) -> DataFrame:
    """doc_id and the code points before its two cuts for another seed, from the stored index alone."""
    ship(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                x = RankIndex(np.array(r["first"]), np.array(r["base"]), np.array(r["slope"]), np.frombuffer(r["residual"], np.int8))
                rows.append((r["doc_id"], *cut(r["doc_id"], r["n"], x, seed)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["doc_id", "prefix_chars", "before_suffix_chars"])

    return index.select("doc_id", "n", "first", "base", "slope", "residual").mapInArrow(run, StructType([StructField(c, LongType()) for c in ("doc_id", "prefix_chars", "before_suffix_chars")]))


def digests_sql(table: str = "documents") -> str:
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {table}),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT doc_id, text, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') OR h[3] % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || p || '{S}' || s || '{M}' || m ELSE '{S}' || s || '{P}' || p || '{M}' || m END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM x"""

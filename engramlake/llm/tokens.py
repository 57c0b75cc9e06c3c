"""Token counts by the whole-token shortcut.

Before any document is read, every vocabulary string is encoded alone; those that come back as their own single id are
proven whole tokens. A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is a proven whole token
counts one without any merging; only the others are merged by the tokenizer's library, and each of those once per
worker while it stays in a bounded memo. Rows never leave their partition: no shuffle.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids keep one row each; special
strings inside a text count as the library's default does (one token each); very long texts are cut piece by piece, so
memory follows a fixed number of pieces; columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import ship

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces of one text that are held at a time, and merged pieces that a worker remembers.
PIECES, MEMO = 200_000, 1_500_000
#: Characters on whose classes the pattern's library and the tokenizer agree (the tests compare all of them); a text with
#: others is cut by the tokenizer's own splitter, which is slower.
AGREED = r"[^\x00-\u0557\u2000-\u206F\u20A0-\u20BF\u2100-\u22FF\u3000-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ShortcutCounter:
    """Counts tokens of whole texts with a memo of proven whole tokens."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(pattern)
        self.odd = regex.compile(AGREED)
        self.letters = byte_letters()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = regex.compile("|".join(regex.escape(t.content) for t in added.values())) if added else None
        self.whole = dict.fromkeys(self.prove(), 1)
        self.memo = dict(self.whole)

    def prove(self) -> Iterator[str]:
        """Vocabulary strings that are one pre-token and encode alone as exactly their own id."""
        ids = sorted(self.tokenizer.get_vocab(with_added_tokens=False).values())
        strings = self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        for i, s, e in zip(ids, strings, self.tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
            if e.ids == [i] and self.pieces.findall(s) == [s]:
                yield s

    def merged(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece.encode()])))

    def _learn(self, pieces: list[str]) -> None:
        missing = set(pieces).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO:
            self.memo = dict(self.whole)
            missing = set(pieces).difference(self.memo)
        for p in missing:
            self.memo[p] = self.merged(p)

    def _cut(self, text: str) -> Iterator[str]:
        if self.odd.search(text):
            return (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return iter(self.pieces.findall(text)) if len(text) <= PIECES else (m.group() for m in self.pieces.finditer(text))

    def _plain(self, text: str) -> int:
        found, total = self._cut(text), 0
        while pieces := list(islice(found, PIECES)):
            self._learn(pieces)
            total += sum(map(self.memo.__getitem__, pieces))
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(1 for _ in self.special.finditer(text)) + sum(self._plain(p) for p in self.special.splititer(text) if p)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> ShortcutCounter:
    return ShortcutCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, by the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in batches:
            n = [c.count(t.as_py()) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

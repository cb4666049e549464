"""Token counts by a whole-token shortcut.

Offline, for every vocabulary string: it is *whole* if its characters are one pre-token and
merging its bytes ends in that one token. Such a pre-token counts 1 without any merging;
only the others are merged. Counts of chunks (see bpe) are kept, so a frequent chunk
is cut and merged once.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from bytefacts.llm import common
from bytefacts.llm.bpe import ByteBpe, Cache, byte_bpe, chunks, settled

LIMIT = 1024


def whole_tokens(bpe: ByteBpe) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as one token: each is encoded by the library itself, merges and all."""
    likely = []
    for raw, i in bpe.by_bytes.items():
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if settled(s) and bpe.pattern.findall(s) == [s]:
            likely.append((s, i))
    said = bpe.library.encode_batch([s for s, _ in likely], add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(likely, said, strict=True) if e.ids == [i])


class Counter:
    def __init__(self, path: str):
        self.bpe = byte_bpe(path)
        self.whole = whole_tokens(self.bpe)
        self.first = Cache(self.chunk, 50_000)
        self.rest = Cache(lambda c: self.chunk(" " + c))

    def chunk(self, chunk: str) -> int:
        if not chunk:
            return 0
        if not settled(chunk):
            return len(self.bpe.library.encode(chunk, add_special_tokens=False).ids)
        if chunk in self.whole:
            return 1
        whole, merge, n = self.whole, self.bpe.merger.encode_ordinary, 0
        for token in self.bpe.pattern.findall(chunk):
            n += 1 if token in whole else len(merge(token))
        return n

    def plain(self, text: str) -> int:
        words = chunks(text)
        return self.first[words[0]] + sum(map(self.rest.__getitem__, words[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(1 if isinstance(x, int) else self.plain(x) for x in self.bpe.pieces(text))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    give repeated rows; an empty table gives an empty one; extra columns are ignored.
    Texts of any length are counted whole. One pass, no shuffle.
    """

    def kernel(ids: list, texts: list) -> dict:
        count = counter(tokenizer).count
        n = [count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.map_texts(docs, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", kernel, id_col, text_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

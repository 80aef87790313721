"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDECIDED = "und"
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, joined by blanks."""
    return " ".join(_WORDS.findall(text.lower())).encode() if text else b""


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int, max_chars: int) -> dict[str, list[str]]:
    """A bounded sample of labelled rows: per language the ``per_lang`` smallest id hashes among texts with
    a letter, each from its first letter on and up to ``max_chars`` characters. The only thing that is fitted on a sample."""
    start = F.regexp_replace(F.col(text_col), r"^\P{L}+", "")
    own = docs.select(F.col(id_col).alias("i"), F.substring(start, 1, max_chars).alias("t"), F.col(lang_col).alias("l"))
    fit = own.filter("i is not null and l is not null and length(t) > 0")
    share = F.lit(0.0)  # of a language's hashes that is looked at: three times what is taken, so no task gets a whole language
    for r in fit.groupBy("l").count().collect():  # a row per language
        share = F.when(F.col("l") == r["l"], F.lit(min(1.0, 3 * per_lang / r["count"]))).otherwise(share)
    few = fit.select("i", "l").filter(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) <= share * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 30)), "i"))
    ids = [r[0] for r in few.withColumn("nth", nth).filter(F.col("nth") <= per_lang).select("i").collect()]
    out: dict[str, list[str]] = {}
    for l, t, _ in sorted(map(tuple, fit.filter(F.col("i").isin(ids)).select("l", "t", F.xxhash64("i")).collect()), key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(l, []).append(t)
    return out


def dictionaries(texts: dict[str, list[str]], size: int) -> dict[str, bytes]:
    """Raw content of at most ``size`` bytes per language, whole texts up to that."""
    out = {}
    for lang, ts in sorted(texts.items()):
        raw = b" ".join(x for x in map(letters, ts) if x)[:size]
        if raw:
            out[lang] = raw
    return out


class Coder:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dicts: dict[str, bytes], level: int = 6, chunk: int = 2048):
        self.langs, self.chunk, self.coders = sorted(dicts), chunk, []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dicts[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        """A long text goes in chunks, so that it is matched with the dictionary and not with itself."""
        parts = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the smallest size wins, ties go to the first name."""
        raw = letters(text)
        if not raw or not self.langs or not _LETTER.search(text):
            return UNDECIDED, 0.0, 0.0
        sizes = self.sizes(raw)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        heat = 1.0 + 0.005 * len(raw)  # sizes are sums over a text whose parts are not independent
        score = 1.0 / sum(math.exp((sizes[best] - s) / heat) for s in sizes)
        return self.langs[best], score, (second - sizes[best]) / second


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, max_chars: int = 20_000, size: int = 96 * 1024, level: int = 6, min_margin: float = 0.01) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) for each row of docs.

    ``learn`` holds labelled rows. ``rejected`` marks margins under ``min_margin`` between the two best
    sizes, where a careful caller takes no language. Texts that are null or have no letter, and all texts
    where nothing could be learned, are ``und`` with score 0 and rejected. Texts are compressed whole."""
    dicts = dictionaries(sample(learn, text_col, lang_col, id_col, per_lang, max_chars), size)
    sent = docs.sparkSession.sparkContext.broadcast(dicts)  # languages x size bytes

    def run(batches):
        coder = Coder(sent.value, level)
        for b in batches:
            got = [coder.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[2] < min_margin for g in got], pa.bool_())],
                ["id", "lang_pred", "score", "margin", "rejected"],
            )

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double, rejected boolean")

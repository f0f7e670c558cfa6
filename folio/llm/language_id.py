"""Language by compression: the per-language zstandard dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended

#: Letters, as Spark's \\p{L} has them; in ASCII these are the word characters but for digits and the underscore.
LETTERS, ASCII_LETTERS = regex.compile(r"\p{L}+"), re.compile(r"[a-z]+")
UNDETERMINED = "und"
#: Bytes that are compressed at once: a dictionary helps little beyond them, as a text then repeats itself.
SEGMENT = 16_384


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, the language with most learned rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int
    least_margin: float


def normal(text: str) -> bytes:
    """The words of letters, lower-cased, between single spaces: what is compressed, in training and prediction."""
    text = text.lower()
    return " ".join((ASCII_LETTERS if text.isascii() else LETTERS).findall(text)).encode("utf-8", "surrogatepass")


def fit_languages(docs: DataFrame, learn: Column, dictionary_bytes: int = 64_000, sample_docs: int = 64, most_languages: int = 1024, level: int = 6, least_margin: float = 0.005) -> LanguageModel:
    """Dictionaries from a bounded sample: up to ``sample_docs`` whole texts of each language, while ``dictionary_bytes`` hold them.

    Rows where ``learn`` holds, text and lang are not null and the text has a letter count. Texts over
    ``dictionary_bytes`` don't fit and stand back, the shortest first; then those of 200 characters or more come
    first, in the order of a hash of their text. A text that no longer fits is left out whole; a language that has
    only texts over the bound learns the shortest of them. The limit applies before and after the window's shuffle,
    so a frequent language costs no more than others. The driver gets texts of a language until they sum to twice
    ``dictionary_bytes``, and one text over the bound at most. Every language is learned; over ``most_languages`` raise an
    error, as each costs a compression of every text. Languages are ordered by their number of rows, which decides
    ties. Repeated rows count as often as they stand there.
    """
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counts = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages + 1).collect()]
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    over = F.octet_length("text") > dictionary_bytes
    order = Window.partitionBy("lang").orderBy(F.when(over, F.octet_length("text")).otherwise(0), (F.length("text") < 200).asc(), F.xxhash64("text"), "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
    sample = ranked.withColumn("before", before).where((F.col("before") < 2 * dictionary_bytes) & (~over | (F.col("n") == 1))).select("lang", "n", "text")
    parts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        content, held = normal(r["text"]), parts[r["lang"]]
        if not held or sum(map(len, held)) + len(held) + len(content) <= dictionary_bytes:
            held.append(content)
    return LanguageModel(tuple((lang, b" ".join(parts[lang])) for lang in counts), level, least_margin)


class Compressors:
    """Compressors of a model, made where they are used, as they can't be sent."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.langs, self.by = model, [], []
        for lang, content in model.dictionaries:
            if len(content) >= 8:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=model.level)
                compressor = zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            else:
                compressor = zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False)
            self.langs.append(lang)
            self.by.append(compressor)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin by which it is smaller than the next as part of the next, and whether that suffices."""
        content = normal(text) if text else b""
        if not content or not self.by:
            return UNDETERMINED, 0.0, False
        segments = [content[i : i + SEGMENT] for i in range(0, len(content), SEGMENT)]
        sizes = [sum(len(c.compress(s)) for s in segments) for c in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = 1 - sizes[best] / second
        return self.langs[best], margin, margin >= self.model.least_margin


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and accepted.

    ``docs`` has a text column; a column of ``docs`` that has the name of a new one is replaced. The score is the
    margin, from 0 to 1; ``accepted`` is false where it is narrower than the model's least margin. A text is
    compressed in segments of ``SEGMENT`` bytes, each against the dictionary, and the margin is that of the summed
    sizes, so it doesn't shrink with the text's length. Null texts and texts without a letter are ``und`` with
    score 0 and not accepted. Rows are independent and nothing is shuffled.
    """
    names = [n for n in docs.columns if n not in ("lang_pred", "score", "accepted")]
    kept = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model)
        for batch in batches:
            made = [compressors.predict(x.as_py()) for x in batch.column(at)]
            added = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "lang_pred", "score", "accepted"])

    schema = extended(kept.schema, "lang_pred string, score double, accepted boolean")
    return kept.mapInArrow(run, schema)

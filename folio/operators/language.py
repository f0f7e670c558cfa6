"""Language guesses from scripts and function words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words by language, in the order that breaks ties, and the blocks of other scripts.
FUNCTION_WORDS = {
    "en": "the and of to is in that it for with as was on are this be by at from or an have not but which",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au aux avec ce ne se sont plus par",
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem des sich auch es als wie oder bei",
    "es": "el la los las de y en que un una es por con para del se no al su como más pero lo",
    "it": "il lo la i gli le di e che un una è per con non del della in da sono si come più anche",
    "pt": "o a os as de e que um uma é em para com não do da dos das por se mais como mas",
    "nl": "de het een en van in is dat op te niet met voor zijn er aan ook als maar bij door",
}
SCRIPTS = {
    "zh": r"\x{4E00}-\x{9FFF}",
    "ko": r"\x{AC00}-\x{D7AF}",
    "el": r"\x{0370}-\x{03FF}",
    "ru": r"\x{0400}-\x{04FF}",
    "he": r"\x{0590}-\x{05FF}",
    "ar": r"\x{0600}-\x{06FF}",
    "hi": r"\x{0900}-\x{097F}",
    "th": r"\x{0E00}-\x{0E7F}",
}
KANA = r"\x{3040}-\x{30FF}"
LEAST_LETTERS, SHARE, LEAST_HITS, MARGIN, LONGEST_WORD = 12, 0.6, 3, 1.3, 12


def guess_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``guess``: the script's language if it has three fifths of the letters, else that of most function words.

    A Latin text needs three hits and 1.3 times those of the next language; below a threshold the guess is null.
    The votes are counted within the row, so nothing is shuffled.
    """
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    # The other scripts are counted in what is left without Latin letters, and the votes among function words alone.
    count = lambda block: F.regexp_count("_rest", F.lit(f"(?=\\p{{L}})[{block}]"))
    function_words = sorted({w for known in FUNCTION_WORDS.values() for w in known.split()})
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.length(w) <= LONGEST_WORD) & w.isin(function_words))
    sized = docs.withColumns({"_letters": letters, "_words": words, "_rest": F.regexp_replace(text, r"[\x{0000}-\x{036F}]+", "")})
    hits = lambda known: F.size(F.filter("_words", lambda w: w.isin(known.split())))
    votes = [F.struct(hits(known).alias("hits"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, known) in enumerate(FUNCTION_WORDS.items())]
    sized = sized.withColumn("_votes", F.sort_array(F.array(*votes), asc=False))
    first, second = F.col("_votes")[0], F.col("_votes")[1]
    limit = F.col("_letters") * SHARE
    kana, han = count(KANA), count(SCRIPTS["zh"])
    guess = F.when(F.col("_letters") < LEAST_LETTERS, F.lit(None).cast("string")).when((kana > 0) & (kana + han >= limit), F.lit("ja"))
    others = kana
    for lang, block in SCRIPTS.items():
        guess = guess.when(count(block) >= limit, F.lit(lang))
        others = others + count(block)
    latin = F.col("_letters") - others
    wins = (latin >= limit) & (first["hits"] >= LEAST_HITS) & (first["hits"] >= second["hits"] * MARGIN)
    return sized.withColumn("guess", guess.when(wins, first["lang"])).drop("_letters", "_words", "_votes", "_rest")

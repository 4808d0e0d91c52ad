"""Language of a text from function words and spelling marks (es, en, pt or und)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of each language, spelling marks, the word pattern and the thresholds.
STOPWORDS = {
    "es": (
        "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una",
        "su", "al", "es", "lo", "como", "más", "pero", "sus", "ha", "o", "este", "sí", "porque", "esta", "entre",
        "cuando", "muy", "sobre", "también", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante",
    ),
    "en": (
        "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not",
        "he", "this", "are", "or", "his", "from", "at", "which", "but", "have", "an", "they", "you", "were", "their",
        "has", "will", "been", "would", "there", "we", "these", "its", "also", "more", "can", "such",
    ),
    "pt": (
        "de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "é", "com", "não", "uma", "os", "no", "se", "na",
        "por", "mais", "as", "dos", "como", "mas", "ao", "ele", "das", "à", "seu", "sua", "ou", "quando", "muito",
        "nos", "já", "eu", "também", "só", "pelo", "pela", "até", "isso", "ela", "entre", "depois", "sem",
    ),
}
MARKS = {"pt": "[ãõâêô]", "es": "[ñ¿¡]"}
MARK_WEIGHT = 12.0
WORD = "[a-záéíóúüñàâãêôõçè]+"
SAMPLE = 20_000
LEAST_WORDS, LEAST_SCORE = 15, 0.02
#: The order in which ties are broken.
ORDER = ("es", "en", "pt")


def _one_of(words: tuple[str, ...]):
    return lambda w: w.isin(*words)


def detect(text: Column) -> Column:
    """The words are found once and bound to a name, so each language only looks them up."""

    def of(x: Column) -> Column:
        words, sample, score = x["words"], x["sample"], {}
        for lang in ORDER:
            own = F.size(F.filter(words, _one_of(STOPWORDS[lang]))) / F.greatest(F.size(words), F.lit(1))
            marks = F.regexp_count(sample, F.lit(MARKS[lang])) / F.greatest(F.length(sample), F.lit(1)) * MARK_WEIGHT if lang in MARKS else F.lit(0.0)
            score[lang] = (own + marks).alias(lang)
        return F.struct(F.size(words).alias("n"), *score.values())

    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE))
    once = F.transform(F.array(sample), lambda s: F.struct(s.alias("sample"), F.regexp_extract_all(s, F.lit(WORD), F.lit(0)).alias("words")))

    def pick(s: Column) -> Column:
        best = F.greatest(*(s[lang] for lang in ORDER))
        first = F.when(s[ORDER[0]] == best, ORDER[0]).when(s[ORDER[1]] == best, ORDER[1]).otherwise(ORDER[2])
        return F.when((s["n"] < LEAST_WORDS) | (best <= LEAST_SCORE), "und").otherwise(first)

    return F.get(F.transform(F.transform(once, of), pick), F.lit(0))

"""Proper names by rules, and the plug-in points for statistical recognisers and for relations.

A text is read once as a stream of tokens. Runs of capitalised words, with link words between them, are names; the words
around a run look up its type in tables. All word tables belong to a `Lexicon`, which can be given; the default holds the
fixed values below, and its stop words are the function words of the three languages. `common_words` derives more stop
words from a corpus: words that are written in lower case more often than not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.languages import STOPWORDS

# Lengths of a name, how much of a sentence may be capitals, and the words that type a name.
SHORTEST, LONGEST, MOST_CAPITALS = 3, 60, 0.6
ARTICLES = ("el", "la", "los", "las", "un", "una", "unos", "unas", "o", "a", "os", "as", "um", "uma", "uns", "umas", "le", "les", "une", "des", "du")
LINKS = ("de", "del", "de la", "de los", "de las", "da", "do", "das", "dos", "la", "las", "los", "el", "y", "e", "di", "du", "van", "von")
ORGANISATIONS = (
    "ministerio", "ministério", "ejercito", "ejército", "exercito", "exército",
    "fuerza", "forca", "força", "comando", "agencia", "agência", "instituto",
    "universidad", "universidade", "grupo", "frente", "bloque", "bloco",
    "comision", "comisión", "comissao", "comissão", "consejo", "conselho",
    "federacion", "federación", "federacao", "federação", "organizacion",
    "organización", "organizacao", "organização", "secretaria", "secretaría",
    "corporacion", "corporación", "corporacao", "corporação", "fundacion",
    "fundación", "fundacao", "fundação", "observatorio", "observatório",
    "tribunal", "corte", "fiscalia", "fiscalía", "policia", "policía", "polícia",
    "armada", "batallon", "batallón", "batalhao", "batalhão", "brigada",
    "division", "división", "divisao", "divisão", "empresa", "banco", "gobierno",
    "governo", "congreso", "congresso", "senado", "camara", "cámara", "câmara",
    "alcaldia", "alcaldía", "gobernacion", "gobernación", "defensoria",
    "defensoría", "procuraduria", "procuraduría", "contraloria", "contraloría",
    "registraduria", "registraduría", "departamento administrativo", "cartel",
    "cártel", "partido", "movimiento", "movimento", "sindicato", "asociacion",
    "asociación", "associacao", "associação", "camara de comercio", "red",
)
PERSON_TITLES = (
    "presidente", "presidenta", "ministro", "ministra", "general", "coronel",
    "capitan", "capitán", "teniente", "almirante", "alcalde", "alcaldesa",
    "gobernador", "gobernadora", "senador", "senadora", "representante",
    "doctor", "doctora", "senor", "señor", "senora", "señora", "embajador",
    "embajadora", "director", "directora", "comandante", "secretario",
    "secretaria", "fiscal", "juez", "jueza", "papa", "rey", "reina", "diputado",
    "diputada", "concejal", "vicepresidente", "canciller", "procurador",
    "defensor", "obispo", "monsenor", "monseñor", "profesor", "profesora",
    "investigador", "investigadora", "analista", "periodista",
)
PLACE_CUES = (
    "departamento de", "municipio de", "município de", "corregimiento de",
    "vereda de", "ciudad de", "cidade de", "region de", "región de", "regiao de",
    "região de", "provincia de", "província de", "estado de", "estado do",
    "parque nacional", "resguardo de", "cuenca del", "cuenca de", "rio", "río",
    "golfo de", "bahia de", "bahía de", "sierra de", "valle del", "valle de",
    "frontera con", "subregion de", "subregión de", "localidad de",
)
# Column headers and shapes that flattened tables leave behind.
TABLE_HEADERS = (
    "columnas", "journal/book", "publication year", "pmid", "funded bys",
    "gender", "first author", "create date", "completion date", "last update",
    "enrollment", "sponsor", "other ids", "study type", "study desig",
    "primary completion", "start date", "citation", "conditions",
    "interventions", "locations", "phases", "outcome", "brief summary",
    "authors", "abstract", "affiliation", "doi", "issn", "keywords",
)
TABLE_SHAPES = (r"^https?://", r"^\S+\s+[A-Z]{1,3}\.?\s*\|", r"^\s*\|", r"\|\s*$", r"^(?i:chapter|cap[íi]tulo)\s+\d+\s*[:|]", r"\d+\(\d+\):\d+")
TABLE_NOISE = "|".join([*TABLE_SHAPES, "(?i:" + "|".join(h.replace("/", "\\/") for h in TABLE_HEADERS) + r")\s*:"])

#: A recogniser: text -> (name, type) pairs. A statistical model is plugged in as one.
Recogniser = Callable[[str], Iterable[tuple[str, str]]]
#: A relation finder: text and its entities' names -> (subject, relation, object). A dependency parser is plugged in as one.
RelationFinder = Callable[[str, list[str]], Iterable[tuple[str, str, str]]]

_TOKEN = re.compile(r"(?P<word>[\w’'\-À-ÿ]+)|(?P<end>[.!?;:](?=\s)|\n|[•·▪◦‣])|(?P<gap>[^\S\n]+)|(?P<sign>.)", re.DOTALL)
_CAPITAL = re.compile(r"[A-ZÁÉÍÓÚÝÑÜÀÂÃÄÊËÎÏÔÕÖÙÛÇ]")
_ROMAN = re.compile(r"[IVXLCDM]+")
_NOISE = re.compile(TABLE_NOISE)


@dataclass(frozen=True)
class Lexicon:
    """Word tables of the rules. Words and phrases are in lower case; phrases have at most three words."""

    organisations: frozenset[str] = frozenset(ORGANISATIONS)
    titles: frozenset[str] = frozenset(PERSON_TITLES)
    places: frozenset[str] = frozenset(PLACE_CUES)
    articles: frozenset[str] = frozenset(ARTICLES)
    links: frozenset[str] = frozenset(LINKS)
    stop: frozenset[str] = field(default_factory=lambda: frozenset(w for ws in STOPWORDS.values() for w in ws) | frozenset(ARTICLES))

    def kind(self, name: list[str], before: list[str]) -> str:
        """The type of a name from its own words and those just before it."""
        if any(phrase in self.organisations for phrase in phrases(name)):
            return "ORGANIZACION"
        ends = {" ".join(before[-k:]) for k in range(1, len(before) + 1)}
        return "PERSONA" if ends & self.titles else "LUGAR" if ends & self.places else "OTRO"


def phrases(words: list[str]) -> Iterable[str]:
    return (" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))


@dataclass
class _Sentence:
    words: list[str] = field(default_factory=list)
    #: Whether only blanks stand between a word and the one before it.
    joined: list[bool] = field(default_factory=list)
    length: int = 0
    letters: int = 0
    capitals: int = 0

    def runs(self, links: frozenset[str]) -> Iterable[tuple[int, int]]:
        """(first, end) of maximal runs of capitalised words, which link words may connect."""
        big = [_CAPITAL.match(w) is not None for w in self.words]
        at, n = 0, len(self.words)
        while at < n:
            if not big[at]:
                at += 1
                continue
            end = at + 1
            while True:
                step = next((k for k in (0, 1, 2) if end + k < n and big[end + k] and all(self.joined[end : end + k + 1]) and (not k or " ".join(self.words[end : end + k]) in links)), None)
                if step is None:
                    break
                end += step + 1
            yield at, end
            at = end


def sentences(text: str) -> Iterable[_Sentence]:
    own, glued = _Sentence(), True
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "end":
            yield own
            own, glued = _Sentence(), True
            continue
        own.length += len(token)
        if kind == "word":
            own.words.append(token)
            own.joined.append(glued)
            own.letters += sum(map(str.isalpha, token))
            own.capitals += sum(map(str.isupper, token))
            glued = True
        elif kind == "sign":
            glued = False
    yield own


def rule_names(text: str, lexicon: Lexicon | None = None) -> list[tuple[str, str]]:
    """(name, type) of a text, each name once with the type of its first place. Headlines (mostly capitals) are left out."""
    lex, found = lexicon or Lexicon(), {}
    for s in sentences(text):
        if s.length < 4 or s.capitals > MOST_CAPITALS * s.letters:
            continue
        for first, end in s.runs(lex.links):
            own = s.words[first:end]
            if first == 0 and len(own) == 1:
                continue  # any word may open a sentence with a capital
            if len(own) > 1 and own[0].lower() in lex.articles:
                own = own[1:]
            name, low = " ".join(own), [w.lower() for w in own]
            if name in found or not SHORTEST <= len(name) <= LONGEST or _ROMAN.fullmatch(name) or lex.stop.issuperset(low) or _NOISE.search(name):
                continue
            back = first
            while back > max(0, first - 3) and s.joined[back]:
                back -= 1
            found[name] = lex.kind(low, [w.lower() for w in s.words[back:first]])
    return sorted(found.items())


def recognise(rows: DataFrame, recogniser: Recogniser = rule_names, text: str = "text") -> DataFrame:
    """rows (row_id, text) -> row_id, canonical, type by any recogniser; names that are table artefacts go."""

    @F.pandas_udf("array<struct<canonical:string,type:string>>")
    def names(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"canonical": a, "type": b} for a, b in recogniser(t or "") if not _NOISE.search(a)])

    return rows.select("row_id", F.explode(names(text)).alias("_e")).select("row_id", "_e.*")


def relate(rows: DataFrame, ents: DataFrame, finder: RelationFinder, text: str = "text") -> DataFrame:
    """rows (row_id, text), ents (row_id, canonical) -> facts (row_id, s, r, o), each once; both ends are entities of the row."""

    @F.pandas_udf("array<struct<s:string,r:string,o:string>>")
    def facts(texts: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, names, strict=True):
            known = set(own)
            out.append([{"s": s, "r": r, "o": o} for s, r, o in dict.fromkeys(finder(t or "", list(own))) if s in known and o in known and s != o])
        return pd.Series(out, index=texts.index)

    own = ents.groupBy("row_id").agg(F.sort_array(F.collect_set("canonical")).alias("_names"))
    return rows.join(own, "row_id").select("row_id", F.explode(facts(text, "_names")).alias("_f")).select("row_id", "_f.*")


def common_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """word, n: words that a corpus writes in lower case at least as often as with a capital; stop words for a Lexicon."""
    w = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}]+"), F.lit(0))).alias("_w"))
    plain = F.col("_w") == F.lower("_w")
    n = w.groupBy(F.lower("_w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(plain, 1).otherwise(0)).alias("_low"))
    return n.where(2 * F.col("_low") >= F.col("n")).select("word", "n")

"""From fused rows to documents and fragments, batched over all queries.

Candidates are rows (qid, row_id, score, rnk). Order-dependent selections run per query over its candidates, whose
number the lists' cut-offs bound (a few hundred), so no task collects more than that for one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import is_contents_page, sentences, word_count, words
from quillmesh.operators.vectors import dot

# Fixed values of retrieval.
TOP_K = 200
MAX_PER_DOC = 3
N_DOCUMENTS, N_FRAGMENTS = 3, 10
CLASS_BOOST, TEMPERATURE = 0.15, 0.05
COPY_COSINE, TRANSLATION_COSINE = 0.98, 0.95
MAX_OVERLAP = 0.7
EXPAND_WORDS, LEAST_ROOM, LEAST_JOIN = 245, 25, 20
#: Positions that share a join key when neighbours are fetched.
BAND = 64


def rerank(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rnk", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("row_id"))))


def class_prior(query_vectors: DataFrame, class_centroids: DataFrame, boost: float = CLASS_BOOST, temperature: float = TEMPERATURE) -> DataFrame:
    """(slug, qid, v), (slug, class, v) -> qid, class, factor: softmax over classes of similarities summed over encoders."""
    c = class_centroids.select("slug", "class", F.col("v").alias("_c"))
    sims = query_vectors.join(F.broadcast(c), "slug").groupBy("qid", "class").agg(F.sum(dot(F.col("v"), F.col("_c"))).alias("s"))
    w = W.partitionBy("qid")
    e = sims.withColumn("_e", F.exp((F.col("s") - F.max("s").over(w)) / temperature)).withColumn("_any", F.max(F.abs("s")).over(w) > 0)
    return e.where("_any").select("qid", "class", (1 + F.lit(boost) * F.col("_e") / F.sum("_e").over(w)).alias("factor"))


def apply_prior(fused: DataFrame, rows: DataFrame, prior: DataFrame) -> DataFrame:
    """fused with scores times the factor of the row's class (1 where there is none), ranked anew. Filters nothing."""
    got = fused.join(rows.select("row_id", "class"), "row_id", "left").join(prior, ["qid", "class"], "left")
    return rerank(got.select("qid", "row_id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score")))


def roll_up(fused: DataFrame, rows: DataFrame, tail_weight: float = 0.0, tail_n: int = 0) -> DataFrame:
    """qid, doc, score, best_row: the best row of a document plus a weighted tail of the next ones."""
    w = W.partitionBy("qid", "doc").orderBy(F.col("score").desc(), F.col("row_id"))
    x = fused.join(rows.select("row_id", "doc"), "row_id").withColumn("_r", F.row_number().over(w))
    head, tail = F.max("score"), F.sum(F.when((F.col("_r") > 1) & (F.col("_r") <= 1 + tail_n), F.col("score")).otherwise(0.0))
    return x.groupBy("qid", "doc").agg((head + F.lit(float(tail_weight)) * tail).alias("score"), F.min_by("row_id", "_r").alias("best_row"))


def top_documents(docs: DataFrame, n: int = N_DOCUMENTS) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc"))
    return docs.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)


def majority_language(rows: DataFrame) -> DataFrame:
    """doc, lang: the most frequent language of its rows, null as und, ties to the one that comes first by row_id."""
    n = rows.groupBy("doc", F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_first"))
    return n.groupBy("doc").agg(F.max_by("lang", F.struct("_n", -F.col("_first"))).alias("lang"))


def without_copies(docs: DataFrame, vectors: DataFrame, languages: DataFrame, n: int = N_DOCUMENTS, copy: float = COPY_COSINE, translation: float = TRANSLATION_COSINE) -> DataFrame:
    """docs (qid, doc, score) -> qid, doc, score, rnk: the best n that are no copies of those chosen before.

    vectors: doc, slug, v. A copy is above `copy` in all encoders, or above `translation` in all and of another
    language. What was passed over fills the list if it stays short. copy <= 0 or >= 1 takes the plain top n.
    """
    if copy <= 0 or copy >= 1:
        return top_documents(docs, n).select("qid", "doc", "score", "rnk")
    v = vectors.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("slug", F.col("v").cast("array<double>").alias("v")))).alias("_v"))
    x = docs.select("qid", "doc", "score").join(v, "doc", "left").join(languages.select("doc", "lang"), "doc", "left")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc"], ascending=[False, True], kind="stable")
        chosen, shown, passed = [], [], []
        for r in rows.itertuples(index=False):
            if len(chosen) >= n:
                break
            own = None if r.vectors is None else [list(s["v"]) for s in r.vectors]
            least = [min(sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(own, o, strict=False)) for o, _ in shown] if own is not None else []
            other = [bool(r.lang and lang and r.lang != lang) and 0 < translation < copy for _, lang in shown]
            if any(c > copy or (o and c > translation) for c, o in zip(least, other, strict=False)):
                passed.append(r)
                continue
            chosen.append(r)
            if own is not None:
                shown.append((own, r.lang))
        chosen += passed[: n - len(chosen)]
        return pd.DataFrame([(r.qid, r.doc, r.score, k) for k, r in enumerate(chosen, 1)], columns=["qid", "doc", "score", "rnk"])

    kinds = dict(docs.dtypes)
    x = x.withColumnRenamed("_v", "vectors").select("qid", "doc", "score", "vectors", "lang")
    return x.groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, doc {kinds['doc']}, score double, rnk int")


def contents_last(fused: DataFrame, rows: DataFrame) -> DataFrame:
    """fused with contents pages after all others, else in the same order."""
    # only candidates' texts are looked through
    own = rows.select("row_id", "text").join(fused.select("row_id").distinct(), "row_id", "left_semi")
    toc = own.select("row_id", is_contents_page(F.col("text")).alias("_toc"))
    order = W.partitionBy("qid").orderBy(F.coalesce("_toc", F.lit(False)), F.col("rnk"))
    return fused.join(toc, "row_id", "left").withColumn("_new", F.row_number().over(order)).select("qid", "row_id", "score", F.col("_new").alias("rnk"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three lower-case words; of a shorter text, the whole."""
    # the words are bound to a variable, so that they are made once and not for each position
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
    return F.array_distinct(F.get(F.transform(F.array(words(F.lower(text))), of), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def diverse_by_cap(fused: DataFrame, rows: DataFrame, n: int = N_FRAGMENTS, per_doc: int = MAX_PER_DOC) -> DataFrame:
    """The first n rows with at most per_doc of one document: two rankings, no sequential step."""
    x = fused.join(rows.select("row_id", "doc"), "row_id").withColumn("_in_doc", F.row_number().over(W.partitionBy("qid", "doc").orderBy("rnk"))).where(F.col("_in_doc") <= per_doc)
    return x.withColumn("_new", F.row_number().over(W.partitionBy("qid").orderBy("rnk"))).where(F.col("_new") <= n).select("qid", "row_id", "doc", "score", F.col("_new").alias("rnk"))


def diverse(fused: DataFrame, rows: DataFrame, n: int = N_FRAGMENTS, per_doc: int = MAX_PER_DOC, most: float = MAX_OVERLAP) -> DataFrame:
    """qid, row_id, doc, score, rnk: rows in order, at most per_doc of a document and none that overlaps a kept one.

    If fewer than n are left, the best of the others fill the list.
    """
    # only candidates' texts are cut into trigrams
    texts = rows.select("row_id", "doc", "text").join(fused.select("row_id").distinct(), "row_id", "left_semi")
    x = fused.join(texts.select("row_id", "doc", trigrams(F.col("text")).alias("grams")), "row_id")

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rnk", kind="stable")
        kept, prints, per = [], [], {}
        for i, r in enumerate(own.itertuples(index=False)):
            if len(kept) >= n:
                break
            g = set(r.grams)
            if per.get(r.doc, 0) >= per_doc or any(len(g & h) / min(len(g), len(h)) > most for h in prints if g and h):
                continue
            kept.append(i)
            prints.append(g)
            per[r.doc] = per.get(r.doc, 0) + 1
        kept += [i for i in range(len(own)) if i not in kept][: n - len(kept)]
        out = own.iloc[kept][["qid", "row_id", "doc", "score"]]
        return out.assign(rnk=range(1, len(out) + 1))

    kinds = dict(x.dtypes)
    return x.groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, row_id {kinds['row_id']}, doc {kinds['doc']}, score double, rnk int")


def join_pieces(pieces: list[str]) -> str:
    """Texts in a row, without the longest end of one (over 20 characters) that begins the next."""
    out = ""
    for piece in filter(None, (p.strip() for p in pieces)):
        size = next((k for k in range(min(len(out), len(piece)), LEAST_JOIN, -1) if out.endswith(piece[:k])), 0)
        out = f"{out} {piece[size:].lstrip()}".strip() if out else piece
    return out


def expand(hits: DataFrame, rows: DataFrame, target: int = EXPAND_WORDS) -> DataFrame:
    """hits (row_id, ...) with text: the row's own and whole neighbours, next and previous in turn, up to `target` words.

    rows: row_id, doc, pos, text. Running sums of words over (doc, pos) tell how far neighbours can be needed: up to the
    target and the first row that doesn't fit. A band join on (doc, pos) fetches them; blank ones are left out. Room of
    at least 25 words is filled with whole sentences of the next neighbour, then of the previous one.
    """
    ids = hits.select("row_id").distinct()
    rows = rows.select("row_id", "doc", "pos", F.coalesce("text", F.lit("")).alias("text"))
    own = rows.join(ids, "row_id", "left_semi").select(F.col("row_id").alias("_id"), "doc", F.col("pos").alias("_at"))
    # a row of more words than the target never fits and counts as target + 1, so sums in the range hold the first one, too
    x = rows.join(own.select("doc").distinct(), "doc", "left_semi").groupBy("doc", "pos").agg(F.least(word_count(F.max("text")), F.lit(target + 1)).cast("long").alias("_n"))
    x = x.withColumn("_run", F.col("pos") - F.row_number().over(W.partitionBy("doc").orderBy("pos")))
    run = W.partitionBy("doc", "_run")
    x = x.withColumn("_sum", F.sum("_n").over(run.orderBy("pos")) - F.col("_n"))
    within = run.orderBy("_sum").rangeBetween(-2 * target - 1, target)  # the words before a row tell whether the next ones end in it
    x = x.select("doc", F.col("pos").alias("_at"), F.min("pos").over(within).alias("_lo"), F.max("pos").over(within).alias("_hi"))
    band = lambda c: F.floor(F.col(c) / BAND)
    own = own.join(x, ["doc", "_at"]).withColumn("_band", F.explode(F.sequence(band("_lo"), band("_hi"))))
    near = rows.select("doc", "pos", "text", word_count(F.col("text")).alias("_n"), band("pos").alias("_band")).join(own, ["doc", "_band"])
    near = near.where(F.col("pos").between(F.col("_lo"), F.col("_hi")) & ((F.col("_n") > 0) | (F.col("pos") == F.col("_at"))))
    # what can't be used stays behind: texts that don't fit whole, sentences of the row itself and those beyond the target
    side, said = F.col("pos") - F.col("_at"), sentences(F.col("text"))
    some = F.when(side > 0, F.slice(said, 1, target)).when(side < 0, F.slice(said, F.greatest(F.size(said) - target + 1, F.lit(1)), F.lit(target)))
    item = F.struct(side.alias("d"), F.when((side == 0) | (F.col("_n") <= target), F.col("text")).alias("text"), F.col("_n").alias("n"), some.alias("s"))
    near = near.groupBy("_id", (F.col("_lo") - F.col("_at")).cast("long").alias("lo"), (F.col("_hi") - F.col("_at")).cast("long").alias("hi")).agg(F.sort_array(F.collect_list(item)).alias("near"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few rows of a batch at a time are Python objects."""

        def one(items, first: int, last: int) -> str:
            at = {r["d"]: (r["text"], r["n"], r["s"]) for r in items}
            text, total, _ = at[0]
            row = lambda d: at.get(d) or (("", 0, []) if first <= d <= last else None)
            if total >= target:
                return text
            after, before, step = [], [], {1: 1, -1: 1}
            grew = True
            while grew:
                grew = False
                for side, to in ((1, after), (-1, before)):
                    got = row(side * step[side])
                    if got and total + got[1] <= target:
                        to.append(got[0])
                        total += got[1]
                        step[side] += 1
                        grew = True
            for side, to in ((1, after), (-1, before)):
                got = row(side * step[side])
                if got and target - total >= LEAST_ROOM:
                    part, n = [], 0
                    for s in got[2] if side > 0 else got[2][::-1]:
                        k = len(s.split())
                        if total + n + k > target:
                            break
                        part.append(s)
                        n += k
                    if part:
                        to.append(" ".join(part if side > 0 else part[::-1]))
                        total += n
            return join_pieces([*before[::-1], text, *after])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, lo, hi, near = batch.slice(at, 64).columns
                grown = [one(*r) for r in zip(near.to_pylist(), lo.to_pylist(), hi.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(grown, pa.string())], names=["row_id", "text"])

    return hits.join(near.mapInArrow(grow, f"row_id {dict(rows.dtypes)['row_id']}, text string"), "row_id")

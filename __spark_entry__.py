
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracles import ORACLES  # noqa: E402
from tomeseek.functions import dense  # noqa: E402
from tomeseek.operators import cleaning, collection, context, indexing, names, passages, quantised, ranking, search, vector_upkeep, vectors  # noqa: E402
from tomeseek.plans.ask import answer_context as ask  # noqa: E402
from tomeseek.plans.glossary import corpus_glossary  # noqa: E402
from tomeseek.session import new_folder, written  # noqa: E402
from tomeseek.sources import tables  # noqa: E402
from tomeseek.sources.index import Index  # noqa: E402
from tomeseek.streaming import standing  # noqa: E402
from tomeseek.streaming.ingest import ingest_stream  # noqa: E402

K = 10
BUDGET = 400
N_LISTS = 16

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, label: str, make: Callable[[], object]):
    """What several queries share (the index, hits) is made once for each session and folder."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _index(spark: SparkSession, folder: str) -> Index:
    return _once(spark, folder, "index", lambda: indexing.build_index(
        tables.documents(spark, folder), new_folder(spark, "index")))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "hits", lambda: written(bm25_search(spark, folder), "hits"))


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "glossary", lambda: written(glossary(spark, folder), "glossary"))


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "mentions", lambda: written(link_entities(spark, folder), "mentions"))


def _term_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "weights", lambda: written(search.term_weights(_index(spark, folder)), "weights"))


def _vectors(spark: SparkSession, folder: str) -> vectors.VectorIndex:
    return _once(spark, folder, "vectors", lambda: vectors.build_vector_index(
        tables.embeddings(spark, folder), new_folder(spark, "vectors"), N_LISTS))


def _codes(spark: SparkSession, folder: str) -> quantised.CodeIndex:
    return _once(spark, folder, "codes", lambda: quantised.build_code_index(tables.embeddings(spark, folder), new_folder(spark, "codes")))


def _vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors whose id is divisible by 100, asked against all."""
    return tables.embeddings(spark, folder).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _label_means(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label, from the whole table: given centres of lists."""
    values = tables.embeddings(spark, folder).select(
        F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = values.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda one: one["x"])
    return _once(spark, folder, "means", lambda: written(
        means.groupBy("query_id").agg(vector.alias("embedding")), "means"))


def _label_index(spark: SparkSession, folder: str) -> vectors.VectorIndex:
    """The vectors in a list for each label, around the label's mean at unit length."""
    def make() -> vectors.VectorIndex:
        means = _label_means(spark, folder).orderBy("query_id").toArrow()
        centers, _ = dense.unit(dense.matrix(means["embedding"].combine_chunks()))
        return vectors.build_vector_index(tables.embeddings(spark, folder), new_folder(spark, "by-label"), len(centers), centers=centers)
    return _once(spark, folder, "by-label", make)


def _editions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two editions of the whole collection.

    The new one drops one language, has another and revises the texts of a
    third; one source has a new name, and the English of another a new code.
    """
    docs = tables.documents(spark, folder)
    revised = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" errata"))).otherwise(F.col("text"))
    source = F.when(F.col("source") == "src3", "src3b").otherwise(F.col("source"))
    lang = F.when((F.col("lang") == "en") & (F.col("source") == "src5"), "en-GB").otherwise(F.col("lang"))
    new = docs.where("lang <> 'es'").withColumns({"text": revised, "source": source, "lang": lang})
    return docs.where("lang <> 'de'"), new


def _arriving(docs: DataFrame, label: str) -> tuple[str, int]:
    """A folder of the documents in files, as many as an index would have buckets, and the half of their number."""
    source, files = new_folder(docs.sparkSession, label), max(4, indexing.bucket_count(docs))
    docs.repartition(files, "doc_id").write.parquet(source)
    return source, -(-files // 2)


# Preparation and index

def passage_windows(spark: SparkSession, folder: str) -> DataFrame:
    cut = passages.passages(tables.documents(spark, folder))
    return cut.select("doc_id", "chunk", F.array_join("tokens", " ").alias("words"), "n_tokens", "own", "lang", "source")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.page_text(tables.pages(spark, folder))


def drop_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_boilerplate(tables.documents(spark, folder))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return collection.exact_dedup(tables.documents(spark, folder))


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return collection.exact_copies(tables.documents(spark, folder))


def corpus_profile(spark: SparkSession, folder: str) -> DataFrame:
    return collection.corpus_profile(tables.documents(spark, folder), tables.labels(spark, folder))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _index(spark, folder).postings()
    return rows.withColumn("positions", F.array_join("positions", " "))


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).term_stats()


def passage_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).passages().select("doc_id", "chunk", F.col("n_tokens").alias("len"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).corpus_stats()


def keyterms(spark: SparkSession, folder: str) -> DataFrame:
    return search.keyterms(_index(spark, folder), 20)


def index_delta(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.index_delta(*_editions(spark, folder))


def index_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of an index built from the old edition and then refreshed to the new one."""
    old, new = _editions(spark, folder)
    index = indexing.build_index(old, new_folder(spark, "editions"))
    return indexing.refresh_index(index, new).term_stats()


def index_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Postings of an index built from the old edition, refreshed to the new one and merged to one batch."""
    old, new = _editions(spark, folder)
    index = indexing.refresh_index(indexing.build_index(old, new_folder(spark, "to-merge")), new)
    rows = indexing.compact_index(index, drop_old=True).postings()
    return rows.withColumn("positions", F.array_join("positions", " "))


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of an index filled by a stream over the documents in files, half of them in each micro-batch."""
    docs = tables.documents(spark, folder)
    source, per_batch = _arriving(docs, "incoming")
    path = new_folder(spark, "streamed")
    index = indexing.create_index(spark, path, indexing.bucket_count(docs))
    return ingest_stream(spark, source, index, new_folder(spark, "stream-state"), max_files=per_batch).term_stats()


def standing_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, as a stream of files, matched with the first eight words of each question."""
    docs, asked = tables.documents(spark, folder), tables.questions(spark, folder)
    source, per_batch = _arriving(docs, "arriving")
    short = asked.select("query_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))
    questions = standing.file_questions(short, _index(spark, folder).term_stats())
    return standing.match_stream(spark, source, questions, new_folder(spark, "matches"), new_folder(spark, "match-state"), max_files=per_batch)


# Search

def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25_search(tables.questions(spark, folder), _index(spark, folder), K)


def bm25_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Each question asked once for each language, of that language's documents only."""
    langs = tables.documents(spark, folder).agg(F.array_sort(F.collect_set("lang")).alias("langs")).scalar()
    asked = tables.questions(spark, folder).withColumn("langs", langs)
    asked = asked.select("query_id", "text", F.size("langs").alias("n"), F.posexplode("langs").alias("i", "lang"))
    asked = asked.select((F.col("query_id") * F.col("n") + F.col("i")).alias("query_id"), "text", "lang")
    return search.bm25_search(asked, _index(spark, folder), K)


def feedback_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.feedback_search(tables.questions(spark, folder), _index(spark, folder), K)


def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.phrase_search(tables.questions(spark, folder), _index(spark, folder))


def proximity_search(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest stretch with all words of each question, and of each question's first eight words."""
    asked = tables.questions(spark, folder)
    short = asked.select((-1 - F.col("query_id")).alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))
    return search.proximity_search(asked.unionByName(short), _index(spark, folder), K)


def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.vector_search(_vector_queries(spark, folder), _vectors(spark, folder), K)


def vector_search_ivf(spark: SparkSession, folder: str) -> DataFrame:
    """Eight of the ten lists: recall is 0.93 against the exact search (README)."""
    return vectors.vector_search_ivf(_vector_queries(spark, folder), _label_index(spark, folder), K, 8)


def vector_index_upkeep(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search on an index built from half of the vectors, to which the others came in two updates and from which some went."""
    rows = tables.embeddings(spark, folder)
    index = vectors.build_vector_index(rows.where("vec_id % 2 = 0"), new_folder(spark, "kept-vectors"), N_LISTS)
    index = vector_upkeep.update_vectors(index, rows.where("vec_id % 4 = 1"), rows.where("vec_id % 14 = 0").select("vec_id"))
    index = vector_upkeep.update_vectors(index, rows.where("vec_id % 4 = 3"), crowded=2.0)
    return vectors.vector_search(_vector_queries(spark, folder), index, K)


def vector_search_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """On sixteen bytes a vector; no SQL, recall is in tests/test_quantised.py."""
    return quantised.vector_search_quantised(_vector_queries(spark, folder), _codes(spark, folder), K)


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    plain = search.bm25_search(tables.questions(spark, folder), _index(spark, folder), K, b=0.0)
    return ranking.rank_fusion([_hits(spark, folder), plain], K)


def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    """For every document those related to it."""
    return search.related_documents(None, search.term_weights(_index(spark, folder)), 5)


# Context

def conversation_queries(spark: SparkSession, folder: str) -> DataFrame:
    return context.conversation_queries(tables.conversations(spark, folder))


def assemble_context(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return context.assemble_context(tables.questions(spark, folder), _hits(spark, folder), index.passages(), BUDGET)


def diverse_context(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return context.diverse_context(tables.questions(spark, folder), _hits(spark, folder), index.passages(), BUDGET)


def answer_context(spark: SparkSession, folder: str) -> DataFrame:
    return ask(tables.conversations(spark, folder), _index(spark, folder), K, BUDGET)


# Names

def glossary(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_glossary(_index(spark, folder))


def link_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_entities(_index(spark, folder).passages(), _glossary(spark, folder))


def entity_graph(spark: SparkSession, folder: str) -> DataFrame:
    return names.entity_graph(_mentions(spark, folder))


def misspelt_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.misspelt_names(_index(spark, folder).term_stats(), _glossary(spark, folder))


def link_misspelt(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return names.link_misspelt(index.passages(), index.term_stats(), _glossary(spark, folder))


# Measurement

def paired_test(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search with and without passage lengths, by where it puts the documents that hold a question word for word."""
    plain = search.bm25_search(tables.questions(spark, folder), _index(spark, folder), K, b=0.0)
    return ranking.paired_test(_hits(spark, folder), plain, phrase_search(spark, folder))


def retrieval_eval(spark: SparkSession, folder: str) -> DataFrame:
    """How well keyword search finds the documents that hold a question word for word."""
    return ranking.retrieval_eval(_hits(spark, folder), phrase_search(spark, folder), [1, 5, 10])


QUERIES = {
    "passages": passage_windows,
    "page_text": page_text,
    "drop_boilerplate": drop_boilerplate,
    "exact_dedup": exact_dedup,
    "exact_copies": exact_copies,
    "corpus_profile": corpus_profile,
    "postings": postings,
    "term_stats": term_stats,
    "passage_stats": passage_stats,
    "corpus_stats": corpus_stats,
    "keyterms": keyterms,
    "index_delta": index_delta,
    "index_refresh": index_refresh,
    "index_compact": index_compact,
    "stream_ingest": stream_ingest,
    "standing_questions": standing_questions,
    "bm25_search": bm25_search,
    "bm25_search_filtered": bm25_search_filtered,
    "feedback_search": feedback_search,
    "phrase_search": phrase_search,
    "proximity_search": proximity_search,
    "vector_search": vector_search,
    "vector_search_ivf": vector_search_ivf,
    "vector_search_quantised": vector_search_quantised,
    "vector_index_upkeep": vector_index_upkeep,
    "rank_fusion": rank_fusion,
    "related_documents": related_documents,
    "conversation_queries": conversation_queries,
    "assemble_context": assemble_context,
    "diverse_context": diverse_context,
    "answer_context": answer_context,
    "glossary": glossary,
    "link_entities": link_entities,
    "misspelt_names": misspelt_names,
    "link_misspelt": link_misspelt,
    "entity_graph": entity_graph,
    "retrieval_eval": retrieval_eval,
    "paired_test": paired_test,
}


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus subpackage; none where it is not installed."""
    try:
        import corpus_pipeline
        import tomeseek.llm.queries as llm
    except ImportError:  # the folders, or a library that they need, are not there
        return {}, {}
    sql = dict(llm.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return llm.QUERIES | {"pipeline": corpus_pipeline.run}, sql


def entry(spark: SparkSession) -> DataFrame:
    """The ten best passages for each question."""
    return bm25_search(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return ORACLES | _corpus()[1]

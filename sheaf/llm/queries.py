"""The registered queries of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, chat, htmltext, language, minhash, neargraph, packing, quality, sampling, substring, tokenfiles, topk, turnrepair, whitening
from sheaf.session import ship, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """What the operators' queries count on: settings, and this package on the executors."""
    ship(spark)
    # Rows are whole texts; a batch of the default size holds too many.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return tune(spark)


def query(name: str, oracle: str | None = None):
    """Register a query that gets a function from table name to table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op6_byte_bpe")
def op6_byte_bpe(table) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table("documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_mixture_packing")
def op10_mixture_packing(table) -> DataFrame:
    pieces = packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.with_checksums(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op1_substring_dedup")
def op1_substring_dedup(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op2_minhash_dedup")
def op2_minhash_dedup(table) -> DataFrame:
    return minhash.near_duplicates(table("documents"))


_OP8 = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
    from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op8_exact_topk", _OP8)
def op8_exact_topk(table) -> DataFrame:
    rows = topk.quantized(table("embeddings"), "vec_id", "embedding", 1024)
    found = topk.search(rows.filter("id % 100 = 0"), rows, k=10, by_row=True)
    return found.withColumnRenamed("id", "vec_id")


@query("op9_chat_format")
def op9_chat_format(table) -> DataFrame:
    return chat.repair(table("conversations"))


@query("op3_language_id")
def op3_language_id(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text", "lang")
    part = sampling.remainder(F.col("doc_id"), 5)
    training = docs.filter(part != 0).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    found = language.predict(docs.select("doc_id", "text"), language.fit(training))
    held_out = F.coalesce(sampling.remainder(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@query("op4_quality")
def op4_quality(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(labelled_quality(docs, table("labels")), per_label=None))
    held_out = F.coalesce(sampling.remainder(F.col("row.doc_id"), 4) == 2, F.lit(False))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def labelled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, text, label, weight`` of a bounded sample of the labelled documents outside the held-out fold."""
    marks = labels.filter(sampling.remainder(F.col("doc_id"), 4) != 2).select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    chosen = sampling.weighted(marks.dropna().filter("label in (0, 1)"), quality.PER_LABEL)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label", "weight")


@query("op5_main_text")
def op5_main_text(table) -> DataFrame:
    pages = table("pages").select("page_id", "url", "html")
    found = htmltext.main_text(pages, htmltext.fit(pages))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op7_near_vectors")
def op7_near_vectors(table) -> DataFrame:
    return neargraph.near_duplicates(table("embeddings"))


@query("op11_whitening")
def op11_whitening(table) -> DataFrame:
    found = whitening.whiten(table("embeddings").select("vec_id", "embedding"))
    return found.select("row.vec_id", *(c for c in found.columns if c != "row"))


@query("op12_token_files")
def op12_token_files(table) -> DataFrame:
    files = tokenfiles.write(table("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return files.documents().withColumnRenamed("doc", "doc_id")


# The least cost and audit of every state, row by row; equal costs go by the audit.
_OP13 = r"""
with recursive crc_table as (
    select list_transform(range(256), lambda b: list_reduce(range(8),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) t
), keyed as (
    select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k
    from conversations
), marked as (
    select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::bigint),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 p
    from keyed, crc_table
), damaged as (
    select conv_id, turn, case when p = 4 then 'user' else r end r,
        case p when 1 then '' when 2 then translate(x, '.!?', '') else x end x,
        unnest(range(case when p = 3 then 2 else 1 end)) copy
    from marked where p <> 0
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, r, x) i,
        rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare
    from damaged
), turns as (
    select conv_id, turn, r, x, i, left(r, 1) c,
        case when bare = '' then 2
            when row_number() over (partition by conv_id, r, x order by i) > 1 then 3
            when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end f,
        lag(left(r, 1)) over (partition by conv_id order by i) c0
    from numbered
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
        count(*) filter (f = 2) blank, count(*) filter (f = 3) duplicate, count(*) filter (f = 1) truncated,
        count(*) filter (c0 is not null and c0 || c not in ('su', 'ua', 'au')) illegal, max(i) n
    from turns group by conv_id
), puts as (
    select * from (values
        (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
        (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:')) v(s, t, letters, more)
), edits as (
    select * from (values
        ('D', 0, null, 0), ('D', 1, null, 1), ('D', 2, null, 2), ('D', 3, null, 3),
        ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2),
        ('K', 0, '', 0), ('K', 1, '', 1), ('K', 2, '', 2), ('K', 3, '', 3),
        ('R', 0, null, 2), ('R', 1, null, 2), ('R', 2, null, 3), ('R', 3, null, 2)) v(letter, s, c, t)
), walk as (
    select conv_id, 0::bigint i, 0 state, 0::bigint cost, '' audit, '' made from counts
    union all
    select conv_id, i, state, best.cost, best.audit, made from (
        select w.conv_id, t.i, e.t state,
            min({'cost': w.cost + 5 * length(p.letters)
                + case e.letter when 'D' then 2 else (case when t.f = 1 then 5 else 0 end) + (case when e.letter = 'R' then 1 else 0 end) end,
                'audit': w.audit || p.letters || e.letter}) best,
            arg_min(w.made || p.more || case e.letter when 'D' then ''
                    when 'K' then chr(10) || t.r || ':' || t.x
                    else chr(10) || (case e.t when 2 then 'user' else 'assistant' end) || ':' || t.x end,
                {'cost': w.cost + 5 * length(p.letters)
                + case e.letter when 'D' then 2 else (case when t.f = 1 then 5 else 0 end) + (case when e.letter = 'R' then 1 else 0 end) end,
                'audit': w.audit || p.letters || e.letter}) made
        from walk w join puts p on p.s = w.state
            join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
            join edits e on e.s = p.t and (e.letter = 'D' or t.f < 2) and (e.letter <> 'K' or e.c = t.c)
        group by w.conv_id, t.i, e.t
    )
), ended as (
    select w.conv_id, min({'cost': w.cost + 5 * length(p.letters), 'audit': w.audit || p.letters}) best,
        arg_min(w.made || p.more, {'cost': w.cost + 5 * length(p.letters), 'audit': w.audit || p.letters}) made
    from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i
        join puts p on p.s = w.state and p.t in (0, 3) and not (w.state = 0 and p.t = 3)
    group by w.conv_id
)
select o.conv_id, coalesce(c.gaps, 0)::bigint gaps, coalesce(c.blank, 0) blank, coalesce(c.duplicate, 0) duplicate,
    coalesce(c.truncated, 0) truncated, coalesce(c.illegal, 0) illegal, coalesce(e.best.cost, 0)::bigint cost,
    coalesce(e.best.audit, '') audit, sha256(coalesce(e.made[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) o
    left join counts c on c.conv_id is not distinct from o.conv_id
    left join ended e on e.conv_id is not distinct from o.conv_id
"""


@query("op13_structure_repair", _OP13)
def op13_structure_repair(table) -> DataFrame:
    turns = table("conversations")
    found = turnrepair.repair(turnrepair.damaged(turns)).summary()
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    empty = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.fillna({**empty, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})

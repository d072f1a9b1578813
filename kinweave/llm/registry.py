"""The queries of the ten operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anns, chat, linededup, mixing, packing, quality, sharding, simhash, tiff, tokencount
from .tables import read

#: Weights of the corpus' sources against the others' 1: the large one is held to four parts.
SOURCE_WEIGHTS = {"src0": 4.0}
#: The conversation that is added to the table, to show that control strings in texts survive.
ODD_TEXT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two columns only, so that n_lines and n_dropped have their names.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply(docs, min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, max_distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.placed(docs, SOURCE_WEIGHTS, block_rows=16)
    return mixed.select("doc_id", F.col("kw_source").alias("source"), F.col("kw_number").alias("number"), F.col("kw_block").alias("block"), F.col("kw_slot").alias("slot"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anns.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10, every=100)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    chats = chat.format_chats(rows.unionByName(odd))
    read_back = chats.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.stored_texts(read(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("tiff").cast("long").alias("media_bytes"), F.sha2("tiff", 256).alias("media_sha256"), "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_token_counts, op4_quality, op5_simhash, op6_mixing, op7_nearest, op8_sharding, op9_chat, op10_tiff)}

def _crc32(blob: str) -> str:
    """Byte by byte, without a table."""
    step = "xor(s, b)"
    for _ in range(8):
        step = f"[xor(z >> 1, 3988292384 * (z & 1)) for z in [{step}]][1]"
    pairs = f"list_filter(string_split(regexp_replace(hex({blob}), '(..)', '\\1,', 'g'), ','), lambda h: h <> '')"
    values = f"[('0x' || h)::bigint for h in {pairs}]"
    return f"xor(list_reduce({values}, lambda s, b: {step}, 4294967295::bigint), 4294967295)"


def _feistel(x: str) -> str:
    """``sharding.feistel`` of a number: four rounds over (l, r), a x b pairs."""
    left, right = f"({x} // b)", f"({x} % b)"
    for k in range(4):
        add = f"('0x' || substr(md5('0-{k}-' || {right if k % 2 == 0 else left}), 1, 12))::bigint"
        left, right = (f"(({left} + {add}) % a)", right) if k % 2 == 0 else (left, f"(({right} + {add}) % b)")
    return f"({left} * b + {right})"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
line as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split),
keyed as (select *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
common as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
from keyed k left join common c on k.key = c.key group by doc_id""",
    # The cycle of 23 slots (weights 4 and 1) is searched slot by slot; blocks repeat it.
    "op6_mixing": """
with recursive docs as (select doc_id, coalesce(source, '') as source, md5(coalesce(text, '')) as h from documents),
src as (select list(source order by source) as names, list(case when source = 'src0' then 4 else 1 end order by source) as w from (select distinct source from docs)),
cycle as (select names, w, list_sum(w)::bigint as n from src),
step(t, js, pick) as (
  select 0::bigint, [0::bigint for x in w], 0::bigint from cycle
  union all
  select t + 1, [js[i] + (i = p)::bigint for i in range(1, len(js) + 1)], p from (
    select t, js, list_position(due, list_min(due))::bigint as p from (
      select t, js, [case when js[i] < w[i] and js[i] * n // w[i] <= t then ((js[i] + 1) * n + w[i] - 1) // w[i] else 9e15::bigint end for i in range(1, len(w) + 1)] as due from step, cycle where t < n))),
at_ as (select names[pick] as source, js[pick] - 1 as turn, t - 1 as at_, w[pick] as w, n from step, cycle where pick > 0),
numbered as (select doc_id, source, row_number() over (partition by source order by md5(concat_ws('-', coalesce(doc_id::varchar, ''), h)), doc_id, h) - 1 as number from docs)
select doc_id, source, number, number // 16 as block, (number // 16 // w) * n + at_ as slot from numbered join at_ using (source) where number // 16 % w = turn""",
    "op8_sharding": f"""
with recursive docs as materialized (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 16 as size, coalesce({_crc32("encode(text)")}, 0) as text_crc32 from documents),
num as (select *, row_number() over (order by md5(concat_ws('-', coalesce(doc_id::varchar, ''), size, text_crc32))) - 1 as number, count(*) over () as n from docs),
halves as (select *, ceil(sqrt(n))::bigint as a from num), whole as materialized (select *, (n + a - 1) // a as b from halves),
walk(number, n, a, b, x) as (select number, n, a, b, {_feistel("number")} from whole union all select number, n, a, b, {_feistel("x")} from walk where x >= n)
select doc_id, size, text_crc32, 'rows' as law, (x % 40)::int as shard, x // 40 as slot, null::double as grown_shard from whole join (select number, x from walk where x < n) using (number)""",
    # Exact nearest neighbours: on a table of one cell, where all codes are scanned, the search finds all of them.
    "op7_nearest": """
with sized as (select vec_id, embedding::double[] as v, len(embedding) as n from embeddings where vec_id is not null
  and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
good as (select vec_id, v from sized where n = (select n from sized group by n order by count(*) desc, n limit 1)),
pair as (select q.vec_id as query_id, c.vec_id, min(sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]))))) as score
  from good q join good c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id group by q.vec_id, c.vec_id)
select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score
from pair qualify rank <= 10""",
    "op9_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
ruled as (select *, lag(role) over w as before, lead(role) over w as after,
  length(role) + length(role) - length(replace(replace(role, '\', ''), '<', '')) as role_chars,
  length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) as text_chars
  from rows window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when before is distinct from role then length('<turn><says>') + role_chars else length('<part>') end
      + case when after is distinct from role then length('</turn>') + 1 else 0 end)::bigint as formatted_chars
from ruled group by conv_id""",
}

"""One query per operator over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.llm import contamination, context_tree, event_prefixes, language, neighbours, object_rules, packing, passages, quality, secrets
from evoq.llm import near_copies as nc
from evoq.llm import spelling, word_bpe
from evoq.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as sidecar texts: the source is the dataset, the document the object."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("key"), F.col("text").alias("content"), "lang")


def remainder(divisor: int) -> Column:
    """crc32 of the document id as text, by a divisor."""
    return F.crc32(F.col("key").cast("string")) % divisor


def _matches_sql(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Places of one kind: the pieces between the matches and the matches give them, in code points."""
    quoted = pattern.replace("'", "''")
    length = lambda parts, last: f"coalesce(list_sum(list_transform({parts}[1:{last}], lambda x: length(x))), 0)"
    start = f"{length('p', 'k')} + {length('m', 'k - 1')}"
    return f"""select doc_id, source, {no} as kind_no, '{kind}' as kind, u.start as start, u.stop as stop, u.value as value from (
        select doc_id, source, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'start': ({start})::bigint,
            'stop': ({start} + length(m[k]))::bigint, 'value': v[k]}})) as u
        from (select doc_id, source, regexp_split_to_array(t, '{quoted}') as p, regexp_extract_all(t, '{quoted}') as m,
              regexp_extract_all(t, '{quoted}', {group}) as v from d where regexp_matches(t, '{quoted}'))) where length(u.value) >= {least}"""


_KINDS_SQL = " union all ".join(_matches_sql(i, *k) for i, k in enumerate(secrets.BASE_KINDS))
_TEXT_OF = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no)"
SECRET_SQL = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
base as ({_KINDS_SQL}),
longer as (select * from ({_matches_sql(3, *secrets.LIVE)}) l where regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
           and not exists (select 1 from base b where b.doc_id = l.doc_id and b.start < l.stop and l.start < b.stop)),
spans as (select *, true as is_base from base union all select *, false from longer),
held as (select value, count(distinct source) as owners, count(distinct (source, doc_id)) as holders from spans group by value),
kept as (select s.*, owners <= 1 and holders < 3 as specific from spans s join held h on h.value = s.value
         where is_base or (owners <= 1 and holders < 3)),
grouped as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
            count(*) filter (where kind = 'hex') as n_hex, {_TEXT_OF} filter (where is_base) as base_text, {_TEXT_OF} as spans,
            count(*) filter (where specific) as n_live, count(*) filter (where not specific) as n_copied from kept group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base_text, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join grouped g on g.doc_id = d.doc_id"""


@query("op1_secret_scan", SECRET_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(sidecars(spark, sf_dir).withColumn("subject", F.col("key")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("key").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


TOP_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id,
             list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""


@query("op2_top_k", TOP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch"), F.col("embedding").alias("features"))
    return neighbours.nearest_trials(trials, F.col("epoch") % 100 == 0).select(
        F.col("query_key").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


# The rules of the query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op3_object_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    return object_rules.judge_objects(objects, RULES).withColumnRenamed("key", "page_id")


NEAR_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) between 1 and 4 then [array_to_string(ws, ' ')]
             else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as shingle from w),
n as (select w.doc_id, count(shingle) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
both_ways as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from both_ways join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from n union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept
from n join (select doc_id, min(other) as component_id from reach group by 1) c on c.doc_id = n.doc_id"""


@query("op4_near_copies", NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nc.near_copies(sidecars(spark, sf_dir)).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def tokenizer_file(name: str) -> str:
    """Text of a public tokenizer file; the installed collection knows the place."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op7_word_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_bpe.encode_texts(sidecars(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return encoded.select(F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(sidecars(spark, sf_dir), held_out=remainder(4) == 2) \
        .select(F.col("key").alias("doc_id"), "held_out", "lang_pred", "score", "accepted")


@query("op5_packed_rows")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed row: its texts, where their pieces begin and end, and digests of the id and position rows."""
    import public_tokenizers

    packed = packing.pack_texts(sidecars(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    return packed.select("pack", "n_tokens", F.col("keys").alias("doc_ids"), "offsets", "ends", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("positions", 256).alias("positions_sha256"))


@query("op6_shared_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return passages.shared_passages(sidecars(spark, sf_dir)).select(
        F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "n_links", "n_words", spans.alias("word_spans"))


@query("op9_context_tree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.tree_scores(sidecars(spark, sf_dir), held_out=remainder(7) == 2).withColumnRenamed("key", "doc_id")


@query("op10_contamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(sidecars(spark, sf_dir), table(spark, sf_dir, "benchmark"), item="item_id", question="text", answer=None)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "overlap")


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i::int + 1, 2))::bigint)"
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, x: {bits}), 4294967295)"


PREFIX_SQL = f"""
with e as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) as event, length(text) as size from e),
own as (select conv_id, list({{'event': event, 'size': size}} order by turn nulls first, event, size) as path, {_crc_sql("conv_id::varchar")} % 6 as h
        from t group by conv_id),
c as (select a.conv_id, list_concat(coalesce(b.path, [])[1:a.h], a.path[a.h + 1:]) as path from own a
      left join own b on b.conv_id = a.conv_id - a.conv_id % 100),
p as (select conv_id, path, unnest(range(0, len(path) + 1)) as depth from c),
n as (select path[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs from p group by 1, 2),
k as (select node[1:depth - 1] as above, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.above = n.node),
u as (select node, conv_id, n_children, case when depth > 0 then (n_convs - 1) * node[depth].size else 0 end as own_saved,
             unnest(range(0, depth + 1)) as up from m),
s as (select node[1:up] as node, count(*) filter (where n_children = 0) as n_leaves, sum(own_saved)::bigint as saved_tokens from u group by 1),
x as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from c group by path)
select m.conv_id, m.depth, a.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens,
       coalesce(x.ends, sha256('')) as ends_sha256
from m join s on s.node = m.node left join m a on m.depth > 0 and a.node = m.node[1:m.depth - 1] left join x on x.path = m.node"""


@query("op11_event_prefixes", PREFIX_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recordings, turns as their events; the first events of each are those of the first of its hundred."""
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording"), F.col("turn").alias("event_pos"),
                                                          F.col("role").alias("type"), F.col("text").alias("value"))
    paths = pin(event_prefixes.recording_paths(events))
    heads = paths.select(F.col("recording").alias("first"), F.slice("path", 1, 5).alias("head"))
    h = (F.crc32(F.col("recording").cast("string")) % 6).cast("int")
    rebuilt = pin(paths.join(heads, F.col("recording") - F.col("recording") % 100 == F.col("first"), "left").select(
        "recording", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("path", 1, 0)),
                              F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path")))
    nodes = event_prefixes.prefix_nodes(rebuilt).join(event_prefixes.ended_digests(rebuilt), "node", "left")
    return nodes.select(F.col("recording").alias("conv_id"), "depth", F.col("parent_recording").alias("parent_conv_id"),
                        F.col("n_recordings").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                        F.coalesce("ended_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op12_sidecar_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality")
    scored = quality.score_quality(sidecars(spark, sf_dir), marks, held_out=remainder(3) == 1)
    return scored.withColumnRenamed("key", "doc_id")


SPELLING_SQL = f"""
with recursive r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{spelling.LETTERS}]+')),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select run, coalesce(doc_id::varchar, '') || ':' || run as spelt, count(*) as n from r where length(run) >= 7 group by 1, 2),
h as (select run, n, {_crc_sql("spelt")} as h from d),
w as (select word, sum(n)::bigint as n from (
          select n, case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from h)
      where length(word) >= 7 group by word having sum(n) >= 2),
g as (select word, n, unnest(range(0, length(word)))::int as gap from w),
cut as (select word, n, gap, left(word, gap) || substr(word, gap + 2) as rest from g),
near as (select distinct a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.gap = b.gap and a.word <> b.word
         union select a.word, b.word, b.n from cut a join w b on a.rest = b.word
         union select b.word, a.word, a.n from cut a join w b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near end as form,
             case when near_n >= 10 * w.n then near_n end as form_n from w left join best on best.word = w.word),
up(word, root) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.root where f.form is not null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n
from f join (select up.word, up.root from up join f on f.word = up.root where f.form is null) e on e.word = f.word"""


@query("op13_spelling_forms", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, of which one in 31 (by document and word) has lost a letter beforehand."""
    runs = spelling.word_runs(sidecars(spark, sf_dir))
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = (h % F.length("word")).cast("int")
    lost = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    spelt = runs.select(F.when(h % 31 == 0, lost).otherwise(F.col("word")).alias("word"))
    return spelling.spelling_forms(spelling.vocabulary(spelt))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

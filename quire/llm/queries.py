"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    exact_dedup, html_text, language_id, license_scan, ngram_join, packing, quality_model, quality_rules, resampling, sentence_pieces, toxicity, warc, whitening,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer installed with Python, on the driver and on executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.train_toxicity(docs, labels, learn=~held_out)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"), F.col("toxicity.sentences").alias("sentences"),
    )


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf, "pages"), with_payload=False, url="url")
    return records.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf, "documents"))


def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf, "documents"))


def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = html_text.page_text(_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_rules(docs).select("doc_id", "rules.*")


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    model = language_id.train_text_model(_table(spark, sf, "documents"))
    return language_id.page_languages(_table(spark, sf, "pages"), model)


def op9_sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), (F.col("text") == F.col("decoded")).alias("round_trip")
    )


def op10_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return quality_model.score_quality(docs, quality_model.train_quality(docs)).select("doc_id", "quality_model.*")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = whitening.components_of(rows, whitening.fit_whitening(rows))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return license_scan.label_licences(license_scan.scan_licences(docs, license_scan.build_index(docs)))


def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    gains = resampling.bucket_gains(docs, _table(spark, sf, "benchmark"))
    # The texts have no further use once they are scored, so they do not move with the draw.
    scored = resampling.score_documents(docs, gains).select("doc_id", "resampling")
    return resampling.draw(scored).select("doc_id", "resampling.n_features", "resampling.weight", "resampling.score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_toxicity, op3_warc, op4_exact_dedup, op5_ngram_join, op6_html_text, op7_quality_rules, op8_language_id, op9_sentence_pieces,
        op10_quality_model, op11_whitening, op12_license_scan, op13_resampling,
    )
}

def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


SQL = {
    "op3_warc": """
        with t as (
          select page_id, encode(coalesce(html, '')) as body from pages
        ), d as (
          select page_id, octet_length(body) as payload_bytes, upper(sha1(body)) as h, min(page_id) over (partition by body) as first from t
        )
        select page_id, payload_bytes,
               array_to_string(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(h, 5 * k + 1, 5) as bigint) >> s) & 31) + 1, 1)), 'string_agg', '')), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id = first then null else first end as refers_to
        from d
    """,
    "op4_exact_dedup": """
        with t as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
        )
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from t window w as (partition by norm)
    """,
    "op12_license_scan": rf"""
        with notices(t, label, body, phrase) as (values {_values((k, *x) for k, x in enumerate(license_scan.TEMPLATES))}
        ), phrases(label, body) as (values {_values(license_scan.PHRASES)}
        ), d as (
          select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
        ), vocabulary as (
          select distinct unnest(string_split(body, ' ')) as w from (select body from notices union all select body from phrases)
        ), occ as (
          select row_no, w, i from (select row_no, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from d) where w in (select w from vocabulary)
        ), idf as (
          select w, ln(1 + ((select count(*) from d) + 1)::double / (coalesce(n, 0) + 1)) as idf from vocabulary left join (select w, count(distinct row_no) as n from occ group by w) using (w)
        ), tw as (
          select t, unnest(string_split(body, ' ')) as w, generate_subscripts(string_split(body, ' '), 1) - 1 as p from notices
        ), td as (
          select t, w, min(p) as p, any_value(idf) as idf, row_number() over (partition by t order by any_value(idf) desc, w) as rarity from tw join idf using (w) group by t, w
        ), total as (
          select t, list_reduce(list_prepend(0::double, list(idf order by w)), lambda a, b: a + b) as weight, least(2, count(*) filter (rarity <= {license_scan.ANCHORS})) as need from td group by t
        ), starts as (
          select distinct row_no, t, i - tw.p as pos from occ join tw using (w) join td using (t, w) where rarity <= {license_scan.ANCHORS}
        ), agreed as (
          select row_no, t, pos from (select distinct s.row_no, s.t, s.pos, a.w from starts s join td a on a.t = s.t and a.rarity <= {license_scan.ANCHORS}
            join occ o on o.row_no = s.row_no and o.w = a.w and abs(o.i - s.pos - a.p) <= {license_scan.SLACK})
          join total using (t) group by row_no, t, pos, need having count(*) >= need
        ), seen as (
          select row_no, t, pos, label, phrase, words[greatest(pos - {license_scan.SLACK}, 0) + 1 : pos + len(string_split(body, ' ')) + {license_scan.SLACK}] as win from agreed join notices using (t) join d using (row_no)
        ), keyed as (
          select row_no, t, pos, label, win from seen where contains(' ' || array_to_string(win, ' ') || ' ', ' ' || phrase || ' ')
        ), rated as (
          select row_no, label, list_reduce(list_prepend(0::double, list(idf order by w)), lambda a, b: a + b) / any_value(weight) as share
          from (select k.row_no, k.t, k.pos, k.label, td.w, td.idf from keyed k join td using (t) where list_contains(k.win, td.w)) join total using (t) group by row_no, t, pos, label
        ), found as (
          select row_no, label, share from rated where share >= {license_scan.LEAST}
        ), places as (
          select o.row_no, f.label, o.i from phrases f join occ o on o.w = string_split(f.body, ' ')[1] join d using (row_no)
          where words[o.i + 1 : o.i + len(string_split(f.body, ' '))] = string_split(f.body, ' ')
        ), b as (
          select row_no, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by row_no
        ), a as (
          select row_no, string_agg(distinct label, ',' order by label) as labels from (select row_no, label from places union all select row_no, label from found) group by row_no
        ), m as (
          select row_no, least(max(share), 1) as best from found group by row_no
        )
        select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
               case when n_base > 0 then 1::double else round(coalesce(best, 0), 9) end as score
        from d left join b using (row_no) left join a using (row_no) left join m using (row_no)
    """,
    "op13_resampling": r"""
        with t as (
          select 'd' as side, row_number() over () as row_no, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents
          union all select 'b', row_number() over (), null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
        ), w as (
          select side, row_no, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from t
        ), f as (
          select side, row_no, unnest(words || list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) as feature from w
        ), h as (
          select feature, hex(encode(feature)) as hex from (select distinct feature from f)
        ), c as (
          -- CRC-32 bit by bit: each byte comes before eight shifts
          select feature, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(length(hex) // 2), lambda k:
                   [cast('0x' || substr(hex, 2 * k + 1, 2) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y:
                   case when y >= 0 then xor(x, y) when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) % 10000 as bucket
          from h
        ), fb as (
          select side, row_no, bucket from f join c using (feature)
        ), n as (
          select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from fb group by bucket
        ), z as (
          select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from n
        ), g as (
          select bucket, cast(floor(1000 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000)))) as bigint) as gain from n, z
        ), m as (
          select row_no, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from fb join g using (bucket) where side = 'd' group by row_no
        ), r as (
          select row_no, doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
                 + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
          from w left join m using (row_no) where side = 'd'
        ), p as (
          select row_no, row_number() over (order by score desc, doc_id nulls last, row_no) as place, count(*) over () as fit from r where n_words >= 20
        )
        select doc_id, n_features, weight, score, case when place <= fit * 25 // 100 then place end as rank from r left join p using (row_no)
    """,
}

"""One query for each operator over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aligning, bpe, chat, licenses, media, mixing, quality, repetition, runs, secrets, simhash, urls, warc
from .common import keep, table

#: Weights of the mixture; whole numbers, so that sums of them are exact in any order.
DOMAIN_WEIGHTS = {"curated": 60, "web": 40}
LANG_WEIGHTS = {"en": 40, "de": 25, "fr": 20, "es": 15}
#: Tokens chosen, as a share of all; times that a document may be taken; seed of the order.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 17


def vocabulary() -> tuple[str, str]:
    """The place of the byte-level vocabulary, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_of_texts(table(spark, sf_dir, "documents"))


def media_carving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a column of mixed payloads, some bytes before it: sound, a picture, a film or, for one in four and the empty ones, as it is.

    What carving finds there: place, length, type, and the type that the whole payload turns out to be of.
    """
    data, k = F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.pmod("doc_id", F.lit(4))
    medium = F.when((k == 3) | (F.octet_length(data) == 0), data).when(k == 0, media.wrapped("wav", data)).when(k == 1, media.wrapped("bmp", data)).otherwise(media.wrapped("mp4", data))
    before = F.repeat(F.lit("x"), F.pmod("doc_id", F.lit(7)).cast("int")).cast("binary")
    payloads = table(spark, sf_dir, "documents").select("doc_id", F.concat(before, medium).alias("payload"), F.lit("text/plain").alias("declared"))
    return media.carve(payloads, "doc_id", "payload", "declared").select("doc_id", "offset", "length", "type", "corrected")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(repetition.repetition(table(spark, sf_dir, "documents")))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def domain_and_tokens() -> tuple[Column, Column]:
    """By columns source and text: domain (sources src0 to src9 are `web`, all others, null too, `curated`), and words (null text: 0)."""
    web = F.coalesce(F.col("source").rlike(r"\Asrc[0-9]\z"), F.lit(False))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return F.when(web, "web").otherwise("curated"), words


def mix_weights(spark: SparkSession) -> list[DataFrame | None]:
    """Weights of domains, of languages in each, and none for sources."""
    domains = spark.createDataFrame(list(DOMAIN_WEIGHTS.items()), "domain string, weight double".replace("double", "long"))
    langs = spark.createDataFrame([(d, k, w) for d in DOMAIN_WEIGHTS for k, w in LANG_WEIGHTS.items()], "domain string, lang string, weight long")
    return [domains, langs, None]


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain, tokens = domain_and_tokens()
    # Words are counted once: what follows works on these rows.
    docs = keep(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", domain.alias("domain"), tokens.alias("tokens")), "mix-documents")
    return mixing.select(docs, ["domain", "lang", "source"], mix_weights(spark), MIX_SHARE, seed=MIX_SEED, epochs=MIX_EPOCHS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts, of which one in ten (by its id's CRC-32) gets a periodic tail first; null texts have no words."""
    docs = table(spark, sf_dir, "documents")
    return runs.digests(docs.select("doc_id", runs.with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, archived and read back; null html is an empty payload."""
    headers, payloads = warc.archive(table(spark, sf_dir, "pages"))
    found = warc.records(keep(headers, "warc-headers"), keep(payloads, "warc-payloads"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both vocabularies' tokens of all texts, aligned; null and empty texts have none."""
    import public_tokenizers

    return aligning.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_media_columns, op4_chat_format, op5_secret_scan, op6_byte_bpe, op7_url_filter, op8_quality_rules, op9_simhash_dedup, op10_source_mix, op11_periodic_runs, op12_warc, op13_cross_tokenizer, media_carving)}

_CHAT = r"""
WITH c AS (SELECT conv_id, list(struct_pack(t := turn, r := role, x := text) ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id),
u AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
kept AS (SELECT conv_id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = u.l))
SELECT conv_id, turn, trim(lower(role)) AS role,
       concat('<|', trim(lower(role)), '|>', chr(10), regexp_replace(text, '<\|(\w+)\|>', '<\1|>', 'g'), '<|end|>') AS rendered
FROM conversations SEMI JOIN kept USING (conv_id)
"""


def _mix_sql() -> str:
    """The share-out of one level, three times, then the prefix of each leaf's order."""
    langs = ", ".join(f"('{d}', '{k}', {w})" for d in DOMAIN_WEIGHTS for k, w in LANG_WEIGHTS.items())
    domains = ", ".join(f"('{d}', {w})" for d, w in DOMAIN_WEIGHTS.items())

    def level(name: str, keys: str, parent: str, weight: str, above: str, join: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        order = f"{part} ORDER BY capacity::DOUBLE / weight, {keys}"
        return f"""
{name}_n AS (SELECT {', '.join(f'g.{k}' for k in keys.split(', '))}, g.capacity, {weight}::DOUBLE AS weight, a.parent_budget
  FROM (SELECT {keys}, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS capacity FROM leaf GROUP BY {keys}) g {join} {above}),
{name}_r AS (SELECT *, (parent_budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}_n),
{name}_f AS (SELECT *, first_value(CASE WHEN rest * weight / weights < capacity THEN struct_pack(r := rest, w := weights) END IGNORE NULLS)
  OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hit FROM {name}_r),
{name} AS (SELECT {keys}, CASE WHEN hit IS NULL THEN capacity ELSE least(capacity, floor(hit.r * weight / hit.w)::BIGINT) END AS parent_budget FROM {name}_f)"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN regexp_full_match(source, 'src[0-9]') THEN 'web' ELSE 'curated' END AS domain,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
wd(domain, weight) AS (VALUES {domains}), wl(domain, lang, weight) AS (VALUES {langs}),
top AS (SELECT floor(sum(tokens) * {MIX_SHARE})::BIGINT AS parent_budget FROM leaf),
{level("b1", "domain", "", "w.weight", "CROSS JOIN top a", "JOIN wd w USING (domain)")},
{level("b2", "domain, lang", "domain", "w.weight", "JOIN b1 a ON g.domain = a.domain", "JOIN wl w ON g.domain = w.domain AND g.lang = w.lang")},
{level("b3", "domain, lang, source", "domain, lang", "1", "JOIN b2 a ON g.domain = a.domain AND g.lang = a.lang", "")},
e AS (SELECT d.*, k::INTEGER AS epoch, md5(concat('{MIX_SEED}:', k, ':', doc_id)) AS o FROM d, range({MIX_EPOCHS}) r(k)),
p AS (SELECT e.*, parent_budget, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, o, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN b3 USING (domain, lang, source))
SELECT doc_id, lang, source, domain, tokens, epoch FROM p WHERE before < parent_budget
"""


_CARVING = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, CASE WHEN doc_id % 4 = 3 OR coalesce(text, '') = '' THEN 3 ELSE doc_id % 4 END AS k, doc_id % 7 AS x FROM documents),
m AS (SELECT *, CASE k WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'image/bmp' WHEN 2 THEN 'video/mp4' END AS type FROM d)
SELECT doc_id, CASE WHEN k < 3 THEN x END::BIGINT AS "offset", CASE k WHEN 0 THEN 44 + n + n % 2 WHEN 1 THEN 54 + (n + 3) // 4 * 4 WHEN 2 THEN 28 + n END::BIGINT AS length, type,
       CASE WHEN x = 0 AND k < 3 THEN type ELSE 'text/plain' END AS corrected FROM m
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.h = o.h
"""


ORACLE_SQL: dict[str, str] = {"op4_chat_format": _CHAT, "op10_source_mix": _mix_sql(), "op12_warc": _WARC, "media_carving": _CARVING}

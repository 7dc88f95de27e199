"""Registered queries of the numbered operators: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import conversations, disclosure, knn, langid, lattice, minhash, mixing, packing, phrases, quality, secrets, suffixes, tokens, toxicity
from tapeline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_mixing(spark, sf_dir):
    """All documents mixed to equal shares of their sources, by characters."""
    return mixing.replicate(documents(spark, sf_dir), sample_id="doc_id", source="source", size="n_chars", told_by="text")


SQL["op1_mixing"] = """WITH d AS (SELECT *, coalesce(source, '~') AS s,
  ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, md5(text), '~')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
sizes AS (SELECT s, sum(greatest(coalesce(n_chars, 0), 0))::DOUBLE AS size FROM d GROUP BY s),
live AS (SELECT s, size FROM sizes WHERE size > 0),
rates AS (SELECT s, (SELECT sum(size) FROM sizes) * (1.0::DOUBLE / (SELECT count(*) FROM live)) / size AS rate FROM live UNION ALL SELECT s, 1.0 FROM sizes WHERE size = 0),
terms AS (SELECT s, rate, k, CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(greatest(k, 1)::DOUBLE) END AS step
  FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS t(k)),
logs AS (SELECT s, k, rate, sum(step) OVER (PARTITION BY s ORDER BY k) AS lg FROM terms),
cdf AS (SELECT s, k, sum(exp(lg - rate)) OVER (PARTITION BY s ORDER BY k) AS c FROM logs),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.s = d.s AND cdf.c <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM n WHERE n > 0"""


@query
def op2_packing(spark, sf_dir):
    """Token pieces of all documents packed into sequences of 2048."""
    pieces = materialize(tokens.token_pieces(documents(spark, sf_dir), "word_bpe_49k.json", "doc_id", "text"))
    # The piece travels as the part of the episode: its place and checksum are needed again.
    episodes = pieces.select(F.col("log_id").alias("trade_id"), F.struct("piece", "start", "ids_crc32").alias("part"), F.col("length").alias("bars_held"))
    packed = packing.pack_episodes(episodes, capacity=2048)
    return packed.select(F.col("trade_id").alias("doc_id"), "part.piece", "part.start", F.col("bars_held").alias("length"), "part.ids_crc32", "sequence_id", "offset")


@query
def op3_knn(spark, sf_dir):
    """The ten highest integer inner products of every hundredth embedding against all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(1024 * finite(x.cast("double"))).cast("double")).alias("whole"))
    found = knn.nearest_signals(whole, F.col("signal_id") % 100 == 0, 10, "vec_id", "whole")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("signal_id").alias("vec_id"), "score")


SQL["op3_knn"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.w) = len(d.w) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op4_toxicity(spark, sf_dir):
    """Toxicity of all documents; labels of two thirds of the ids are used."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    weights = toxicity.train(docs, labels.filter(~held_out), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, weights, "doc_id", "text", threshold=0.7)
    return scored.withColumnRenamed("text_id", "doc_id").select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_langid(spark, sf_dir):
    """Language of all documents, learnt from four fifths of the ids."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = langid.train(docs.filter(~held_out), "doc_id", "text", "lang")
    found = langid.predict(docs, model, "doc_id", "text").withColumnRenamed("text_id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_lattice(spark, sf_dir):
    """Near copies among all embeddings."""
    found = lattice.near_signals(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95, "vec_id", "embedding")
    return found.withColumnRenamed("signal_id", "vec_id")


@query
def op7_suffixes(spark, sf_dir):
    """Bytes of all documents that 200-byte repetitions cover."""
    found = suffixes.repeated_passages(documents(spark, sf_dir), "doc_id", "text", length=200, digest=True)
    return found.select(F.col("log_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


@query
def op8_secrets(spark, sf_dir):
    """Secrets of all documents; a source is the repository and the owner."""
    found = secrets.scan(documents(spark, sf_dir), "doc_id", "text", "source", "source")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        F.col("log_id").alias("doc_id"), *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(secrets.KINDS)],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def _secret_sql() -> str:
    def kind(rank: int) -> str:
        _, pattern, group, least = secrets.KINDS[rank]
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""SELECT r, list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
            s := (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT, k := {rank}, n := length(m[i])::BIGINT, v := v[i])),
            lambda x: length(x.v) >= {least}) AS f FROM (SELECT r, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS p FROM d)"""

    names = "['" + "', '".join([k[0] for k in secrets.KINDS] + ["live"]) + "']"
    text = lambda c: f"coalesce(array_to_string(list_transform(list_sort({c}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source FROM documents),
    k AS (SELECT r, unnest(f) AS x FROM ({kind(0)}) UNION ALL SELECT r, unnest(f) AS x FROM ({kind(1)}) UNION ALL SELECT r, unnest(f) AS x FROM ({kind(2)})),
    spans AS (SELECT k.r, x.s, x.k, x.s + x.n AS e, x.v FROM k), own AS (SELECT v FROM spans JOIN d USING (r) GROUP BY v HAVING count(DISTINCT source) <= 1),
    every AS (SELECT r, s, k, e FROM spans UNION ALL SELECT DISTINCT r, s, 3, e FROM spans WHERE v IN (SELECT v FROM own)),
    a AS (SELECT r, list(struct_pack(s := s, k := k, e := e)) FILTER (WHERE k < 3) AS b, list(struct_pack(s := s, k := k, e := e)) AS al FROM every GROUP BY r)
    SELECT doc_id, {', '.join(f"coalesce(len(list_filter(b, lambda x: x.k = {i})), 0)::BIGINT AS n_{k[0]}" for i, k in enumerate(secrets.KINDS))},
    sha256({text('b')}) AS base_sha256, {text('al')} AS spans FROM d LEFT JOIN a USING (r)"""


SQL["op8_secrets"] = _secret_sql()


@query
def op9_minhash(spark, sf_dir):
    """Near copies among all documents, on two-word shingles."""
    found = minhash.near_copies(documents(spark, sf_dir), "doc_id", "text", k=2, percent=80)
    return found.select(F.col("log_id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op10_quality(spark, sf_dir):
    """Perplexity of all documents under the model of those that labels call good, and whether they stay."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    found = quality.judged(documents(spark, sf_dir), trusted, "doc_id", "text", "lang")
    return found.withColumnRenamed("log_id", "doc_id").drop("message_hash")


@query
def op11_hirschberg(spark, sf_dir):
    """All conversations, damaged by a checksum of id and turn, repaired at least cost."""
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    damaged = original.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code")).filter("code <> 0")
    damaged = damaged.withColumns({"text": text, "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")), "times": F.expr("explode(sequence(1, if(code = 3, 2, 1)))")})
    done, report = conversations.repair(damaged)
    found = report.join(conversations.digests(done, report).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = found.select(F.col("conv_id").alias("i"), *numbers, "audit", "sha256")
    every = original.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("i")), "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# The four states side by side, row by row: each keeps its least (cost, audit) and the rows written so far.
SQL["op11_hirschberg"] = r"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(substr(key, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % 20 AS code FROM k),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, substr(role, 1, 1) AS h FROM d),
f AS (SELECT conv_id, i, turn, role, text, h, lag(h) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN regexp_full_match(text, '[ 	-
]*') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM n),
step(lead, h, p, q, price, edit) AS (VALUES ('', 's', 0, 1, 0, 'K'), ('', 'u', 0, 2, 0, 'K'), ('', 'u', 1, 2, 0, 'K'), ('', 'u', 3, 2, 0, 'K'), ('', 'a', 2, 3, 0, 'K'),
  ('', '', 0, 2, 3, 'R'), ('', '', 1, 2, 3, 'R'), ('', '', 2, 3, 3, 'R'), ('', '', 3, 2, 3, 'R'),
  ('u', 'a', 0, 3, 3, 'IK'), ('u', 'a', 1, 3, 3, 'IK'), ('a', 'u', 2, 2, 3, 'IK'), ('u', 'a', 3, 3, 3, 'IK'),
  ('u', '', 0, 3, 6, 'IR'), ('u', '', 1, 3, 6, 'IR'), ('a', '', 2, 2, 6, 'IR'), ('u', '', 3, 3, 6, 'IR')),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS written FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.written FROM (
    SELECT conv_id, i, q, min(struct_pack(cost := cost, audit := audit, written := written)) AS b FROM (
      SELECT w.conv_id, f.i, w.q, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.written FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, f.i, s.q, w.cost + s.price + CASE WHEN f.fault = 3 THEN 3 ELSE 0 END, w.audit || s.edit,
        w.written || CASE s.lead WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END
          || chr(10) || CASE WHEN s.edit LIKE '%R' THEN CASE s.q WHEN 2 THEN 'user' ELSE 'assistant' END ELSE f.role END || ':' || f.text
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN step s ON s.p = w.q AND (s.h = '' OR s.h = f.h) WHERE f.fault NOT IN (1, 2)) GROUP BY conv_id, i, q)),
ended AS (SELECT conv_id, min(struct_pack(cost := cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, audit := audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    written := written || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END)) AS b
  FROM walk WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM f GROUP BY conv_id) GROUP BY conv_id),
r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND before || h NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.written, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op13_phrases(spark, sf_dir):
    """Phrases of all documents by language."""
    return phrases.collocations(documents(spark, sf_dir), "text", "lang").withColumnRenamed("asset_class", "lang")


SQL["op13_phrases"] = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
u AS (SELECT id, lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM p),
v AS (SELECT lang, w AS x, lead(w) OVER o AS y, lead(w, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, x AS phrase, [x] AS words, 1 AS k, count(*) AS a FROM v GROUP BY lang, x HAVING count(*) >= 10
  UNION ALL SELECT lang, x || ' ' || y, [x, y], 2, count(*) FROM v WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, [x, y, z], 3, count(*) FROM v WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cut AS (SELECT c.lang, c.phrase, c.k, c.words, c.a, s.i, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM f c, (VALUES (1), (2)) AS s(i), f x, f y WHERE c.k >= 2 AND s.i < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.words[1:s.i], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.words[s.i + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part FROM f WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON b.k = 2 AND o.lang = b.lang AND o.part = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n.n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""


@query
def op12_disclosure(spark, sf_dir):
    """Personal data of all documents and the words that disclose it."""
    found = disclosure.scan(documents(spark, sf_dir), "doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        F.col("line_id").alias("doc_id"), *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(disclosure.KINDS)],
        F.sha2(disclosure.written(F.col("base")), 256).alias("base_sha256"), disclosure.written(F.col("spans")).alias("spans"),
    )


def _disclosure_sql() -> str:
    # The plain patterns: this engine's matcher is linear in the text.
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INT ELSE (substr({digits}, i, 1)::INT * 2) // 10 + (substr({digits}, i, 1)::INT * 2) % 10 END)) % 10 = 0"
    valid = ["true", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS BIGINT), 0) > 255)) = 0",
             f"length({digits}) BETWEEN 12 AND 19 AND CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END", f"length({digits}) BETWEEN 9 AND 15"]
    sums = "(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::BIGINT"
    each = lambda source, text, pattern: f"SELECT * EXCLUDE (w, p), w[i] AS m, p[i] AS b, p[i + 1] AS n, {sums} AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS w, string_split_regex({text}, '{pattern}') AS p FROM {source}))"
    kinds = " UNION ALL ".join(f"SELECT r, {k} AS k, m, b, n, s, s + length(m) AS e FROM ({each('d', 't', patterns[k])}) WHERE {valid[k]}" for k in range(4))
    low = lambda c: f"translate({c}, '{disclosure.UPPER}', '{disclosure.LOWER}')"
    names = "['" + "', '".join(disclosure.NAMES) + "']"
    text = lambda c: f"coalesce(array_to_string(list_transform(list_sort({c}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS MATERIALIZED ({kinds}),
    windows AS (SELECT r, k, m AS v, right(b, 40) AS t, s - length(right(b, 40)) AS o, length(b) > 40 AS cut, true AS front FROM spans UNION ALL SELECT r, k, m, left(n, 40), e, length(n) > 40, false FROM spans),
    near AS MATERIALIZED (SELECT r, k, v, {low('m')} AS term, o + s AS s, o + s + length(m) AS e FROM ({each('windows', 't', disclosure.TERM)}) WHERE NOT cut OR CASE WHEN front THEN s > 0 ELSE s + length(m) < length(t) END),
    joint AS (SELECT k, v, term, count(DISTINCT r) AS joint FROM near GROUP BY k, v, term HAVING count(DISTINCT r) >= 2),
    carriers AS (SELECT k, v, count(DISTINCT r) AS carriers FROM (SELECT r, k, m AS v FROM spans) GROUP BY k, v),
    spread AS (SELECT term, count(*) AS spread FROM (SELECT unnest(list_distinct(regexp_extract_all({low('t')}, '{disclosure.TERM}'))) AS term FROM d) WHERE term IN (SELECT term FROM joint) GROUP BY term),
    told AS (SELECT j.k, j.v, j.term, round(CASE WHEN n.n > carriers THEN ln(joint * n.n::DOUBLE / (carriers::DOUBLE * spread)) / ln(n.n::DOUBLE / carriers) ELSE 0 END, 9) AS disclosure
      FROM joint j JOIN carriers c ON c.k = j.k AND c.v = j.v JOIN spread s ON s.term = j.term, (SELECT count(*) AS n FROM d WHERE t <> '') n),
    extra AS (SELECT DISTINCT x.r, x.s, CASE WHEN t.disclosure >= 0.8 THEN 5 ELSE 4 END AS k, x.e FROM near x JOIN told t ON t.k = x.k AND t.v = x.v AND t.term = x.term WHERE t.disclosure >= 0.5),
    a AS (SELECT r, list(struct_pack(s := s, k := k, e := e)) FILTER (WHERE k < 4) AS b, list(struct_pack(s := s, k := k, e := e)) AS al FROM (SELECT r, s, k, e FROM spans UNION ALL SELECT r, s, k, e FROM extra) GROUP BY r)
    SELECT doc_id, {', '.join(f"coalesce(len(list_filter(b, lambda x: x.k = {i})), 0)::BIGINT AS n_{k[0]}" for i, k in enumerate(disclosure.KINDS))},
    sha256({text('b')}) AS base_sha256, {text('al')} AS spans FROM d LEFT JOIN a USING (r)"""


SQL["op12_disclosure"] = _disclosure_sql()


SQL["op6_lattice"] = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.y, reach.c FROM reach JOIN l ON l.x = reach.n),
m AS (SELECT n, min(c) AS c FROM reach GROUP BY n), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept FROM embeddings e LEFT JOIN k ON k.x = e.vec_id JOIN m ON m.n = e.vec_id"""

SQL["op7_suffixes"] = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i + 1:i + 200]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
o AS (SELECT r, i, CASE WHEN i <= lag(i) OVER q + 200 THEN 0 ELSE 1 END AS fresh FROM s WINDOW q AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM o),
x AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY r, k),
e AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM x),
p AS (SELECT e.r, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS front, max(z) AS last, sum(z - a) AS removed, count(*) AS spans FROM e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(front || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256 FROM d LEFT JOIN p USING (r)"""

SQL["op9_minhash"] = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
g AS (SELECT doc_id, CASE WHEN n = 1 THEN w ELSE w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) END AS g FROM u),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS n, doc_id AS c FROM documents UNION SELECT t.y, reach.c FROM reach JOIN t ON t.x = reach.n),
m AS (SELECT n, min(c) AS c FROM reach GROUP BY n)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN z USING (doc_id) JOIN m ON m.n = d.doc_id"""

"""Queries over documents, conversations, pages and embeddings, with their SQL. All of them read whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.operators import bpe, code, evaluate, export, histograms, hybrid, morphology, sequences, unigram
from corpusloom.plans.catalogue import register
from corpusloom.sources.tables import spread
from corpusloom.streaming import shards

HEX = "h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents)"
TOKENS = f"{HEX}, t AS MATERIALIZED (SELECT doc_id, unnest(generate_series(1, len(l))) - 1 AS pos, ('0x' || unnest(l))::BIGINT AS tok FROM h)"
PAIRS = f"{TOKENS}, p AS MATERIALIZED (SELECT tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t), c AS MATERIALIZED (SELECT a, b, count(*) AS cnt FROM p WHERE b IS NOT NULL GROUP BY a, b)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source"))


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.encode(docs(spark, sf))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.packed(docs(spark, sf))


def sides(h: DataFrame) -> DataFrame:
    return h.select(K.key_left(F.col("key")).alias("left"), K.key_right(F.col("key")).alias("right"), "cnt")


@register("byte_histogram", f"WITH {TOKENS} SELECT tok::INTEGER AS tok, count(*) AS cnt FROM t GROUP BY tok")
def byte_histogram(spark, sf):
    return histograms.tokens(seqs(spark, sf))


@register("byte_pairs_topk", f'WITH {PAIRS} SELECT a AS "left", b AS "right", cnt FROM c ORDER BY cnt DESC, a, b LIMIT 20')
def byte_pairs_topk(spark, sf):
    return sides(histograms.top(histograms.pairs(seqs(spark, sf)), 20))


@register("byte_pairs_sql", f'WITH {PAIRS} SELECT a AS "left", b AS "right", cnt FROM c')
def byte_pairs_sql(spark, sf):
    """The whole histogram by built-in functions alone."""
    return sides(histograms.pairs_sql(docs(spark, sf).select("doc_id", K.byte_tokens("text").alias("toks"))))


@register(
    "ngram_histogram_1_4",
    f"""WITH {HEX}, t AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS x FROM h),
q AS (SELECT x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z, lead(x, 3) OVER w AS u FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT 1 AS n, x AS gram FROM q UNION ALL SELECT 2, x || y FROM q WHERE y IS NOT NULL UNION ALL SELECT 3, x || y || z FROM q WHERE z IS NOT NULL UNION ALL SELECT 4, x || y || z || u FROM q WHERE u IS NOT NULL)
SELECT n::INTEGER AS n, gram, count(*) AS cnt FROM g GROUP BY n, gram""",
)
def ngram_histogram(spark, sf):
    grams = histograms.ngrams(seqs(spark, sf), 1, 4)
    return grams.select("n", F.array_join(F.transform("gram", lambda t: F.lpad(F.hex(t.cast("bigint")), 2, "0")), "").alias("gram"), "cnt")


@register("bos_eos_lengths", f"WITH {HEX} SELECT doc_id, len(l) + 2 AS n_tokens, 1 AS first_token, 2 AS last_token FROM h")
def bos_eos_lengths(spark, sf):
    s = sequences.encode(docs(spark, sf), 1, 2)
    return s.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.element_at("toks", 1).alias("first_token"), F.element_at("toks", -1).alias("last_token"))


@register(
    "conversation_sequences",
    "SELECT conv_id, sum(octet_length(encode(coalesce(text, ''))))::BIGINT + 2 AS n_tokens, count(*) AS turns FROM conversations GROUP BY conv_id",
)
def conversation_sequences(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    whole = sequences.encode_chunks(turns, "conv_id", "turn", 1, 2).select("conv_id", F.size("toks").cast("bigint").alias("n_tokens"))
    return whole.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conv_id")


@register(
    "batch_shapes",
    "WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch, octet_length(encode(coalesce(text, ''))) AS n FROM documents) SELECT batch::BIGINT AS batch, count(*) AS n_rows, max(n)::BIGINT AS width, sum(n)::BIGINT AS n_tokens FROM b GROUP BY batch",
)
def batch_shapes(spark, sf):
    return sequences.batch_shapes(sequences.batches(seqs(spark, sf), 64))


@register("corpus_summary", "SELECT count(*) AS sequences, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS tokens, max(octet_length(encode(coalesce(text, ''))))::BIGINT AS max_length FROM documents")
def corpus_summary(spark, sf):
    return sequences.summary(seqs(spark, sf))


def merge_steps(k: int, warm: list[tuple[int, int]] = ()) -> str:
    """SQL of k training steps: best pair, or one of warm at first, then the collapsing merge by neighbours, each step over the one before."""
    parts = [TOKENS.replace("t AS MATERIALIZED", "t0 AS MATERIALIZED", 1)]
    for i in range(k):
        new = 256 + i
        parts.append(f"n{i} AS MATERIALIZED (SELECT doc_id, pos, tok, lag(tok) OVER w AS prev, lead(tok) OVER w AS next FROM t{i} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))")
        if i < len(warm):
            parts.append(f"b{i} AS MATERIALIZED (SELECT {warm[i][0]}::BIGINT AS a, {warm[i][1]}::BIGINT AS b, 0::BIGINT AS cnt)")
        else:
            parts.append(f"b{i} AS MATERIALIZED (SELECT tok AS a, next AS b, count(*) AS cnt FROM n{i} WHERE next IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, a, b LIMIT 1)")
        x, y = f"(SELECT a FROM b{i})", f"(SELECT b FROM b{i})"
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, CASE WHEN tok = {x} AND next = {y} THEN {new} ELSE tok END AS tok FROM n{i} WHERE NOT coalesce(prev = {x} AND tok = {y}, false))")
        half = lambda c, i=i: f"CASE {' '.join(f'WHEN {c} = {256 + j} THEN (SELECT letters FROM p{j})' for j in range(i))} ELSE chr({c}::INTEGER) END"
        parts.append(f"p{i} AS MATERIALIZED (SELECT {half('a') if i else 'chr(a::INTEGER)'} || {half('b') if i else 'chr(b::INTEGER)'} AS letters FROM b{i})")
    return ", ".join(parts)


def merge_rows(k: int) -> str:
    return " UNION ALL ".join(f'SELECT {i} AS step, (SELECT a FROM b{i}) AS "left", (SELECT b FROM b{i}) AS "right", {256 + i}::BIGINT AS new_id, (SELECT cnt FROM b{i}) AS cnt' for i in range(k))


MERGES = merge_steps(3)


@register("bpe_merges_3", f"WITH {MERGES} {merge_rows(3)}")
def bpe_merges(spark, sf):
    return spark.createDataFrame(bpe.train(packed(spark, sf), 3), "step int, left bigint, right bigint, new_id bigint, cnt bigint")


@register("bpe_tokens_after_3", f"WITH {MERGES} SELECT doc_id, count(*) AS n_tokens, sum(tok)::BIGINT AS token_sum FROM t3 GROUP BY doc_id")
def bpe_tokens(spark, sf):
    base = packed(spark, sf)
    rules = [m[1:4] for m in bpe.train(base, 3)]
    return bpe.totals(base, rules, "collapse").where("n_tokens > 0")


@register("collapse_one_pair", f"""WITH {TOKENS}, n AS (SELECT doc_id, pos, tok, lag(tok) OVER w AS prev, lead(tok) OVER w AS next FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, CASE WHEN tok = 101 AND next = 32 THEN 256 ELSE tok END AS tok FROM n WHERE NOT coalesce(prev = 101 AND tok = 32, false))
SELECT doc_id, count(*) AS n_tokens, count_if(tok = 256)::BIGINT AS merged FROM m GROUP BY doc_id""")
def collapse_one_pair(spark, sf):
    """By array functions alone."""
    toks = docs(spark, sf).select("doc_id", K.collapse(K.byte_tokens("text"), 101, 32, 256).alias("toks")).where(F.size("toks") > 0)
    return toks.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.size(F.filter("toks", lambda t: t == 256)).cast("bigint").alias("merged"))


WARM = [(101, 32), (116, 104)]


@register("warm_start_plan", f"WITH {merge_steps(3, WARM)} {merge_rows(3)}")
def warm_start_plan(spark, sf):
    """Two merges from outside are applied first; the third is trained on what they leave."""
    return spark.createDataFrame(bpe.train(seqs(spark, sf), 3, warm=WARM), "step int, left bigint, right bigint, new_id bigint, cnt bigint")


@register("frozen_pairs_excluded", f'WITH {PAIRS}, f AS (SELECT a, b FROM c ORDER BY cnt DESC, a, b LIMIT 5) SELECT a AS "left", b AS "right", cnt FROM c WHERE (a, b) NOT IN (SELECT (a, b) FROM f) ORDER BY cnt DESC, a, b LIMIT 10')
def frozen_pairs_excluded(spark, sf):
    h = histograms.pairs(seqs(spark, sf))
    return sides(histograms.top(h, 10, histograms.top(h, 5)))


@register("span_neighbours", f"""WITH {TOKENS}, m AS (SELECT doc_id, pos, coalesce(tok = 101 AND lead(tok) OVER w = 32, false) AS m FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, m OR coalesce(lag(m) OVER w, false) OR coalesce(lead(m) OVER w, false) AS touched FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS touched FROM x WHERE touched GROUP BY doc_id""")
def span_neighbours(spark, sf):
    from pyspark.sql.window import Window

    p = sequences.positions(seqs(spark, sf))
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = p.withColumn("m", F.coalesce((F.col("tok") == 101) & (F.lead("tok").over(w) == 32), F.lit(False)))
    return histograms.neighbours(marked, F.col("m")).where("touched").groupBy("doc_id").agg(F.count(F.lit(1)).alias("touched"))


@register("compaction_prefix", f"""WITH {TOKENS}, k AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS new_pos FROM t WHERE tok <> 32)
SELECT doc_id, count(*) AS kept, sum(new_pos * tok)::BIGINT AS weighted FROM k GROUP BY doc_id""")
def compaction_prefix(spark, sf):
    kept = histograms.compacted(sequences.positions(seqs(spark, sf)), F.col("tok") == 32)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("new_pos") * F.col("tok")).alias("weighted"))


@register("run_lengths", f"""WITH {TOKENS}, s AS (SELECT doc_id, pos, tok, pos - row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) AS g FROM t), r AS (SELECT doc_id, tok, g, count(*) AS n FROM s GROUP BY doc_id, tok, g)
SELECT tok::INTEGER AS tok, count(*) AS runs, max(n) AS longest FROM r GROUP BY tok""")
def run_lengths(spark, sf):
    return histograms.runs(sequences.positions(seqs(spark, sf))).groupBy("tok").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))


@register("hist_combine_shards", f'WITH {PAIRS} SELECT a AS "left", b AS "right", cnt FROM c')
def hist_combine_shards(spark, sf):
    """Histograms of each language, added up."""
    d = docs(spark, sf)
    known = ["en", "de", "fr", "es"]
    shards_ = [histograms.pairs(sequences.encode(d.where(F.col("lang") == x))) for x in known]
    rest = histograms.pairs(sequences.encode(d.where(~F.coalesce(F.col("lang"), F.lit("")).isin(known))))
    return sides(histograms.total_of(*shards_, rest))


@register("hist_minus", f"""WITH {TOKENS}, p AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t)
SELECT a AS "left", b AS "right", count(*) AS cnt FROM p JOIN documents USING (doc_id) WHERE b IS NOT NULL AND coalesce(lang, '') <> 'en' GROUP BY a, b""")
def hist_minus(spark, sf):
    d = docs(spark, sf)
    return sides(histograms.minus(histograms.pairs(sequences.encode(d)), histograms.pairs(sequences.encode(d.where("lang = 'en'")))))


@register("rank_partition", "SELECT source AS path, ((row_number() OVER (ORDER BY source) - 1) % 4)::INTEGER AS rank FROM (SELECT DISTINCT source FROM documents)")
def rank_partition(spark, sf):
    from corpusloom.sources import files

    paths = docs(spark, sf).select(F.col("source").alias("path"))
    parts = [files.of_rank(paths, r, 4).withColumn("rank", F.lit(r)) for r in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("splitlines", r"""SELECT doc_id, count_if(x <> '')::BIGINT AS n_lines FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS x FROM documents) GROUP BY doc_id""")
def splitlines(spark, sf):
    from corpusloom.sources import files

    rows = F.filter(F.split(F.coalesce("text", F.lit("")), files.LINE_ENDS), lambda x: x != "")
    return docs(spark, sf).select("doc_id", F.size(rows).cast("bigint").alias("n_lines"))


CANDIDATES = f"""{HEX}, t AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS x FROM h),
q AS (SELECT x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT 2 AS n, [x, y] AS gram FROM q WHERE y IS NOT NULL UNION ALL SELECT 3, [x, y, z] FROM q WHERE z IS NOT NULL),
k AS (SELECT gram, n, count(*) AS cnt FROM g GROUP BY gram, n)"""


@register("unigram_candidates", f"""WITH {CANDIDATES} SELECT array_to_string(gram, '') AS gram, n::INTEGER AS n, cnt FROM k ORDER BY cnt DESC, lpad(array_to_string(list_reverse(gram), ''), 6, '0'), n LIMIT 64""")
def unigram_candidates(spark, sf):
    found = unigram.ranked(unigram.candidates(seqs(spark, sf), 3), 3, 64)
    return found.select(F.array_join(F.transform("gram", lambda t: F.lpad(F.hex(t.cast("bigint")), 2, "0")), "").alias("gram"), "n", "cnt")


@register("unigram_mstep", f"WITH {TOKENS}, e AS (SELECT tok AS piece_id, count(*)::DOUBLE AS c FROM t GROUP BY tok) SELECT piece_id, round(ln(greatest((c + 1e-6) / sum(c + 1e-6) OVER (), 1e-12)), 6) AS logp FROM e")
def unigram_mstep(spark, sf):
    counts = histograms.tokens(seqs(spark, sf)).select(F.col("tok").cast("bigint").alias("piece_id"), F.col("cnt").cast("double").alias("exp_count"))
    return unigram.mstep(counts).select("piece_id", F.round("logp", 6).alias("logp"))


@register("unigram_prune", f"""WITH {TOKENS}, e AS (SELECT tok AS piece_id, count(*) AS c FROM t GROUP BY tok), s AS (SELECT count(*) AS n FROM e),
r AS (SELECT piece_id, c, row_number() OVER (PARTITION BY piece_id >= 64 ORDER BY c, piece_id) AS k FROM e)
SELECT piece_id, (row_number() OVER (ORDER BY piece_id) - 1)::INTEGER AS new_id FROM r, s WHERE piece_id < 64 OR k > n - 80""")
def unigram_prune(spark, sf):
    counts = histograms.tokens(seqs(spark, sf)).select(F.col("tok").cast("bigint").alias("piece_id"), F.lit(None).cast("binary").alias("piece"), F.col("cnt").cast("double").alias("exp_count"))
    return unigram.pruned(counts, 80, 64).select("piece_id", "new_id")


@register("prob_softmax", f"WITH {TOKENS}, e AS (SELECT tok AS piece_id, ln(count(*)) AS logp FROM t GROUP BY tok) SELECT piece_id, format('{{:.9f}}', exp(logp) / sum(exp(logp)) OVER ()) AS prob FROM e")
def prob_softmax(spark, sf):
    vocab = histograms.tokens(seqs(spark, sf)).select(F.col("tok").cast("bigint").alias("piece_id"), F.lit(None).cast("binary").alias("piece"), F.log("cnt").alias("logp"))
    return unigram.probabilities(vocab).select("piece_id", F.format_string("%.9f", "prob").alias("prob"))


@register("unigram_estep")
def unigram_estep(spark, sf):
    """Expected counts of bytes and the 64 most frequent pairs, over whole texts; tests hold it against all segmentations of short ones."""
    return unigram.expected(seqs(spark, sf), pair_vocabulary(spark, sf)).select("piece_id", F.round("exp_count", 3).alias("exp_count"))


@register("viterbi_tokens")
def viterbi_tokens(spark, sf):
    return unigram.segment(seqs(spark, sf), pair_vocabulary(spark, sf)).select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"))


def pair_vocabulary(spark: SparkSession, sf: str) -> unigram.Vocabulary:
    top = histograms.top(histograms.pairs(seqs(spark, sf)), 64).collect()
    return unigram.Vocabulary.of_bytes([bytes([b]) for b in range(256)] + [bytes([r["key"] >> 32, r["key"] & 255]) for r in top])


@register("hybrid_cycle")
def hybrid_cycle(spark, sf):
    model = hybrid.fit(packed(spark, sf), 1, 4, 1, 280, 4)
    rows = [(i, p.hex(), round(v, 4)) for i, (p, v) in enumerate(zip(model.vocabulary.pieces, model.vocabulary.logp, strict=True))]
    return spark.createDataFrame(rows, "piece_id bigint, piece string, logp double")


@register("eval_corpus", """WITH x AS (SELECT octet_length(encode(coalesce(text, ''))) AS n, len(regexp_extract_all(coalesce(text, ''), 'e ')) + len(regexp_extract_all(coalesce(text, ''), 'e t')) AS merged FROM documents)
SELECT count(*) AS documents, sum(n)::BIGINT AS total_bytes, sum(n - merged)::BIGINT AS total_tokens, round(sum(n - merged)::DOUBLE / count(*), 6) AS average_tokens, round(sum(n - merged)::DOUBLE / sum(n), 6) AS tokens_per_byte FROM x""")
def eval_corpus(spark, sf):
    """With two merges: e and blank, and what that makes with t."""
    d = docs(spark, sf)
    merged = bpe.apply(sequences.encode(d), [(101, 32, 256), (256, 116, 257)], "greedy")
    totals = evaluate.corpus_totals(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), merged)
    return totals.crossJoin(evaluate.compression(totals)).select("documents", "total_bytes", "total_tokens", F.round("average_tokens", 6).alias("average_tokens"), F.round("tokens_per_byte", 6).alias("tokens_per_byte"))


def ascii_ids(spark: SparkSession) -> DataFrame:
    return spark.range(32, 127).select(F.col("id").cast("int").alias("tok"))


@register("eval_oov", f"WITH {TOKENS} SELECT count_if(tok < 32 OR tok > 126)::BIGINT AS instances, round(count_if(tok < 32 OR tok > 126) / count(*)::DOUBLE, 9) AS rate, count(DISTINCT CASE WHEN tok < 32 OR tok > 126 THEN tok END) AS distinct_items FROM t")
def eval_oov(spark, sf):
    return evaluate.oov(histograms.tokens(seqs(spark, sf)), ascii_ids(spark)).select("instances", F.round("rate", 9).alias("rate"), "distinct_items")


@register("eval_oov_unique", f"WITH {TOKENS} SELECT tok::INTEGER AS tok, count(*) AS cnt FROM t WHERE tok < 32 OR tok > 126 GROUP BY tok")
def eval_oov_unique(spark, sf):
    return evaluate.unknown(histograms.tokens(seqs(spark, sf)), ascii_ids(spark))


@register("eval_by_lang", f"WITH {TOKENS} SELECT lang, count(*) AS tokens, count_if(tok > 126)::BIGINT AS unknown FROM t JOIN documents USING (doc_id) GROUP BY lang")
def eval_by_lang(spark, sf):
    d = docs(spark, sf)
    n = sequences.encode(d).select("doc_id", F.size("toks").alias("n"), F.size(F.filter("toks", lambda t: t > 126)).alias("lost"))
    return n.join(d.select("doc_id", "lang"), "doc_id").where("n > 0").groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum("lost").alias("unknown"))


def script_sql(scripts: dict[str, str]) -> str:
    """Runs of one script by a class of characters each, every other character by itself."""
    digits = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐"
    kinds = scripts | {"SCRIPT=LATIN": "A-Za-z", "SCRIPT=NUMERIC": digits}
    cases = " ".join(f"WHEN regexp_matches(s, '^[{c}]') THEN '{n}'" for n, c in kinds.items())
    blank = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
    return f"""WITH s AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '(?s)({"|".join(f"[{c}]+" for c in kinds.values())}|.)', 1)) AS s FROM documents)
SELECT CASE {cases} WHEN regexp_matches(s, '^[{blank}]') THEN 'CATEGORY=SPACE' ELSE 'CATEGORY=PUNCT' END AS tag, count(*) AS cnt, sum(length(s))::BIGINT AS chars FROM s GROUP BY tag"""


def tag_counts(cut: DataFrame) -> DataFrame:
    return cut.select(F.explode("segments").alias("s")).groupBy(F.col("s.tags")[0].alias("tag")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.char_length("s.surface")).alias("chars"))


@register("script_segments_ja", script_sql({"SCRIPT=KANJI": "一-鿿㐀-䶿", "SCRIPT=HIRAGANA": r"\x{3040}-\x{309F}", "SCRIPT=KATAKANA": "゠-ヿㇰ-ㇿｦ-ﾝ"}))
def script_segments_ja(spark, sf):
    return tag_counts(morphology.segmented(docs(spark, sf), "ja"))


@register("script_segments_ko", script_sql({"SCRIPT=HANGUL": "가-힣"}))
def script_segments_ko(spark, sf):
    return tag_counts(morphology.segmented(docs(spark, sf), "ko"))


@register("recompose", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def recompose(spark, sf):
    """Segments put together again are the text."""
    cut = morphology.segmented(docs(spark, sf), "tr")
    return cut.select("doc_id", F.sha2(morphology.recomposed(F.col("segments")), 256).alias("digest"))


@register("tr_suffixes")
def tr_suffixes(spark, sf):
    cut = morphology.segmented(docs(spark, sf), "tr")
    return cut.select(F.explode("segments").alias("s")).where("size(s.tags) > 0").groupBy(F.array_join("s.tags", " ").alias("tags"), F.col("s.role").alias("role")).agg(F.count(F.lit(1)).alias("cnt"))


@register("morph_purity")
def morph_purity(spark, sf):
    return morphology.totals(morphology.segmented(docs(spark, sf), "tr"))


@register("merge_hashes", f"""WITH {PAIRS} SELECT a AS "left", b AS "right", sha256(encode('pepper') || unhex(lpad(hex(a), 16, '0')) || unhex(lpad(hex(b), 16, '0'))) AS digest FROM c""")
def merge_hashes(spark, sf):
    p = sides(histograms.pairs(seqs(spark, sf)))
    return p.select("left", "right", K.merge_hash("pepper", F.col("left"), F.col("right")).alias("digest"))


@register("byte_alphabet", "WITH b AS (SELECT unnest(generate_series(0, 255)) AS b), s AS (SELECT b, (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255) AS shown FROM b) SELECT b AS byte, CASE WHEN shown THEN chr(b::INTEGER) ELSE chr((255 + sum(CASE WHEN shown THEN 0 ELSE 1 END) OVER (ORDER BY b))::INTEGER) END AS letter FROM s")
def byte_alphabet(spark, sf):
    one = spark.range(256).select(F.col("id").alias("byte"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("piece"))
    return one.select("byte", K.token_string(F.col("piece")).alias("letter"))


@register("piece_table", f"WITH {MERGES} " + " UNION ALL ".join(f"SELECT {256 + i}::BIGINT AS id, letters FROM p{i}" for i in range(3)))
def piece_table(spark, sf):
    """What the first merges stand for."""
    found = bpe.pieces([m[1:4] for m in bpe.train(packed(spark, sf), 3)])
    return spark.createDataFrame([(i, p.decode("latin-1")) for i, p in found.items() if i >= 256], "id bigint, letters string")


WORDS = r"w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\s]+')) AS w FROM documents)"


@register("vocab_tiktoken", f"WITH {WORDS}, c AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT base64(encode(w)) AS line, (row_number() OVER (ORDER BY n DESC, w) - 1)::BIGINT AS rank FROM c ORDER BY n DESC, w LIMIT 500")
def vocab_tiktoken(spark, sf):
    words = docs(spark, sf).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\s]+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = words.orderBy(F.desc("n"), "w").limit(500)
    from pyspark.sql.window import Window

    return top.select(F.base64(F.encode("w", "UTF-8")).alias("line"), (F.row_number().over(Window.orderBy(F.desc("n"), "w")) - 1).cast("bigint").alias("rank"))


@register("ranks_to_merges", f'WITH {PAIRS} SELECT 255 + row_number() OVER (ORDER BY cnt DESC, a, b) AS rank, a AS "left", b AS "right" FROM c ORDER BY cnt DESC, a, b LIMIT 100')
def ranks_to_merges(spark, sf):
    top = histograms.top(histograms.pairs(seqs(spark, sf)), 100).collect()
    rows = [(bytearray([b]), b) for b in range(256)] + [(bytearray([r["key"] >> 32, r["key"] & 255]), 256 + i) for i, r in enumerate(top)]
    return bpe.merges_from_ranks(spark.createDataFrame(rows, "piece binary, rank bigint"))


TURNS = r"s AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\s]+') AS l FROM conversations)"
PATTERNS = f"""{TURNS}, g AS (SELECT n, l[i:i + n - 1] AS pattern FROM (SELECT l, n, unnest(generate_series(1, len(l) - n + 1)) AS i FROM s, (SELECT unnest([2, 3, 4]) AS n) WHERE len(l) >= n)),
k AS (SELECT pattern, n, count(*) AS cnt FROM g GROUP BY pattern, n HAVING count(*) >= 3)"""


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\s]+)"), F.lit(1)).alias("str_toks"))


@register("word_meta_patterns", f"WITH {PATTERNS} SELECT row_number() OVER (ORDER BY n DESC, cnt DESC, pattern) - 1 AS meta, array_to_string(pattern, ' ') AS pattern, n::INTEGER AS len, cnt FROM k")
def word_meta_patterns(spark, sf):
    found = code.numbered(code.patterns(turn_words(spark, sf), 4, 3))
    return found.select("meta", F.array_join("pattern", " ").alias("pattern"), "len", "cnt")


@register("meta_reduction")
def meta_reduction(spark, sf):
    return code.pattern_reduction(turn_words(spark, sf), 4, 3)


@register("symbol_ids", f"""WITH {TURNS}, p AS (SELECT doc_id, unnest(l) AS name, unnest(generate_series(1, len(l))) AS pos FROM s), f AS (SELECT doc_id, name, min(pos) AS pos FROM p GROUP BY doc_id, name)
SELECT doc_id, name, 'SYM' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS symbol FROM f""")
def symbol_ids(spark, sf):
    return code.symbol_ids(turn_words(spark, sf).select("doc_id", F.posexplode("str_toks").alias("pos", "name")))


@register("page_tag_patterns", r"""WITH s AS (SELECT regexp_extract_all(coalesce(html, ''), '<[a-zA-Z/][^>\s]*') AS l FROM pages), g AS (SELECT l[i] || ' ' || l[i + 1] AS pattern FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM s WHERE len(l) > 1)) SELECT pattern, count(*) AS cnt FROM g GROUP BY pattern HAVING count(*) >= 2""")
def page_tag_patterns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    tags = pages.select("page_id", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(<[a-zA-Z/][^>\s]*)"), F.lit(1)).alias("str_toks"))
    return code.patterns(tags, 2, 2).select(F.array_join("pattern", " ").alias("pattern"), "cnt")


@register("dedupe_pairs_cosine", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM e x JOIN e y ON x.vec_id <> y.vec_id)
SELECT a AS vec_id, count(*) AS links, round(max(s), 5) AS best FROM p WHERE s >= 0.5 GROUP BY a""")
def dedupe_pairs_cosine(spark, sf):
    """Of all vectors, how many others are at least so similar to each, and the highest similarity."""
    return export.links(spark.read.parquet(f"{sf}/embeddings.parquet"), 0.5).select("vec_id", "links", F.round("best", 5).alias("best"))


SOURCES = "v AS (SELECT source AS token, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)), s AS (SELECT source AS token, count(*)::DOUBLE AS count FROM documents WHERE lang = 'en' GROUP BY source)"


def source_vocab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    d = docs(spark, sf)
    vocab = d.select(F.col("source").alias("token")).distinct().withColumn("id", F.row_number().over(Window.orderBy("token")) - 1)
    stats = d.where("lang = 'en'").groupBy(F.col("source").alias("token")).agg(F.count(F.lit(1)).cast("double").alias("count")).withColumn("vector", F.lit(None).cast("array<double>"))
    return vocab, stats


@register("token_stats_join", f"WITH {SOURCES} SELECT token, id::INTEGER AS id, coalesce(count, 0) AS count FROM v LEFT JOIN s USING (token)")
def token_stats_join(spark, sf):
    return export.with_stats(*source_vocab(spark, sf)).select("token", "id", "count")


@register("prune_frequency", f"WITH {SOURCES}, x AS (SELECT token, id, coalesce(count, 0) AS count FROM v LEFT JOIN s USING (token)) SELECT token, id::INTEGER AS id, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS new_id FROM x WHERE count >= 15 OR token = 'src0'")
def prune_frequency(spark, sf):
    return export.pruned(export.with_stats(*source_vocab(spark, sf)), 15, ["src0"])[0].select("token", "id", "new_id")


@register("relative_freq_prune", f"WITH {TOKENS}, c AS (SELECT tok, count(*) AS cnt FROM t GROUP BY tok), s AS (SELECT sum(cnt) AS total FROM c) SELECT tok::INTEGER AS tok, cnt, (row_number() OVER (ORDER BY tok) - 1)::INTEGER AS new_id FROM c, s WHERE cnt / total >= 0.01")
def relative_freq_prune(spark, sf):
    return export.relative(histograms.tokens(seqs(spark, sf)), 0.01)


@register("stream_pair_counts", f'WITH {PAIRS} SELECT a AS "left", b AS "right", cnt FROM c')
def stream_pair_counts(spark, sf):
    return sides(shards.stream_pair_counts(spark, docs(spark, sf)))


@register("lang_names", "SELECT DISTINCT lower(trim(lang)) AS name FROM documents WHERE lang IS NOT NULL")
def lang_names(spark, sf):
    return docs(spark, sf).where("lang is not null").select(F.explode(K.names_of(F.concat("lang", F.lit(", "), "lang"))).alias("name")).distinct()


@register("length_types", "SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 1024 THEN 'short' ELSE 'long' END AS kind, octet_length(encode(coalesce(text, ''))) > 1024 AS overflow FROM documents")
def length_types(spark, sf):
    s = seqs(spark, sf)
    over = K.overflows(F.col("toks"), 1024)
    return s.select("doc_id", F.when(over, "long").otherwise("short").alias("kind"), over.alias("overflow"))


@register("first_documents", "SELECT doc_id, length(coalesce(text, '')) AS chars FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark, sf):
    return sequences.limited(docs(spark, sf), 50).select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))


@register("reindex_samples", f"WITH {SOURCES}, x AS (SELECT token, id, coalesce(count, 0) AS count FROM v LEFT JOIN s USING (token)), k AS (SELECT token, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS new_id FROM x WHERE count >= 15) SELECT new_id, count(*) AS samples, sum(toxic)::BIGINT AS positive FROM labels JOIN documents USING (doc_id) JOIN k ON source = token GROUP BY new_id")
def reindex_samples(spark, sf):
    """Labelled samples by their source, those of pruned sources left out."""
    kept = export.pruned(export.with_stats(*source_vocab(spark, sf)), 15, [])[0]
    samples = spark.read.parquet(f"{sf}/labels.parquet").join(docs(spark, sf).select("doc_id", F.col("source").alias("token")), "doc_id")
    return export.reindexed(samples, kept).groupBy("new_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("toxic").cast("bigint").alias("positive"))


@register("tokenizer_stats")
def tokenizer_stats(spark, sf):
    """How a public byte-level vocabulary counts the corpus; tests hold it against the library."""
    import public_tokenizers

    return evaluate.tokenizer_stats(evaluate.tokenizer_counts(docs(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken")))

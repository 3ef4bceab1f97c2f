"""The registered queries of the library's own operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import compact, folded_digest, normalize, prompt_hash, variants
from ..functions.validators import entropy, luhn
from ..operators import chunks, evaluate, gateway, prepare
from ..operators.decide import analyze, analyze_distinct, is_topic_question
from ..operators.masking import mask, pattern_finder
from ..operators.scoring import classifier, entities, guard
from ..policies import LABELS, Policy, policy_frame, seed
from ..session import shared_checkpoints, small_batches, spread
from ..sources import readers
from .examples import EXAMPLES, RAW_ROWS, VARIANTS, is_whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(spread(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))).select("doc_id", "lang", "source", "analysis")


def normalize_digest(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("digest"))


def prompt_hashes(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", prompt_hash(F.col("text")).alias("prompt_hash"))


def sampling_digest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", folded_digest(F.col("text")).alias("digest"))


def leet_compact(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2(compact(normalize(F.col("text"))), 256).alias("compact_sha256"))


def variant_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(variants(F.col("text"))).cast("long").alias("n_variants"))


def entropy_tokens(spark, sf_dir):
    tokens = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(normalize(F.col("text")), F.lit("[a-z0-9_+/=-]{24,}"), F.lit(0))).alias("token"))
    return tokens.select("doc_id", "token", F.round(entropy(F.col("token")), 6).alias("entropy"))


def luhn_candidates(spark, sf_dir):
    runs = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:^|[^0-9])([0-9]{13,19})(?=[^0-9]|$)"), F.lit(1))).alias("digits"))
    return runs.select("doc_id", "digits", luhn(F.col("digits")).alias("valid"))


def policy_hits(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", F.explode("analysis.matched_policy_codes").alias("code"))


def decisions(spark, sf_dir):
    a = F.col("analysis")
    return _judged(spark, sf_dir).select("doc_id", a["decision"].alias("decision"), a["highest_severity"].alias("highest_severity"), F.array_join(a["matched_policy_codes"], ",").alias("codes"), F.array_join(a["safe_detection_summary"], "; ").alias("reasons"))


def decision_summary(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(F.col("analysis.decision").alias("decision")).agg(F.count("*").alias("n"))


def codes_by_lang(spark, sf_dir):
    return _judged(spark, sf_dir).select("lang", F.explode("analysis.matched_policy_codes").alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))


def severity_rollup(spark, sf_dir):
    return _judged(spark, sf_dir).select("lang", F.coalesce("analysis.highest_severity", F.lit("none")).alias("severity")).rollup("lang", "severity").agg(F.count("*").alias("n"))


def reason_counts(spark, sf_dir):
    return _judged(spark, sf_dir).select(F.explode("analysis.safe_detection_summary").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _case(values: list[str | None]) -> Column:
    """The value whose number is the part's key modulo their count."""
    listed = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(listed, (F.col("p_partkey") % len(values) + 1).cast("int"))


def policy_cues(spark, sf_dir):
    """Decisions over the names of parts with a cue for a policy, an intent or a kind of variant after each."""
    cue = F.struct(_case([n for n, _, _ in EXAMPLES]).alias("name"), _case([t for _, t, _ in EXAMPLES]).alias("cue"), _case(["yes" if is_whole(n) else "" for n, _, _ in EXAMPLES]).alias("whole"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", "p_name", cue.alias("c"))
    asked = parts.select("p_partkey", "c.name", F.when(F.col("c.whole") == "yes", F.col("c.cue")).otherwise(F.concat("p_name", F.lit(" "), F.col("c.cue"))).alias("text"))
    told = analyze(asked).select("p_partkey", "name", "analysis.*")
    return told.select("p_partkey", "name", "decision", "highest_severity", F.array_join("matched_policy_codes", ",").alias("codes"), F.array_join("safe_detection_summary", "; ").alias("reasons"))


def variant_cues(spark, sf_dir):
    """The variants of names of parts with something hidden after each."""
    parts = table(spark, sf_dir, "part").select("p_partkey", _case([n for n, _, _ in VARIANTS]).alias("name"), F.concat("p_name", F.lit(" "), _case([t for _, t, _ in VARIANTS])).alias("text"))
    return parts.select("p_partkey", "name", F.array_join(variants(F.col("text")), " | ").alias("variants"))


def own_policies(spark, sf_dir):
    """Decisions of an administrator's own keywords and patterns, one policy switched off."""
    mine = [
        Policy("WORD", "pii", "low", "Word", keywords=("RED", "Anvil")),
        Policy("SHAPE", "jailbreak", "medium", "Shape", regex_patterns=(r"^[a-m].*e$", r"\bs\w+\s+r")),
        Policy("OFF", "pii", "critical", "Off", enabled=False, keywords=("e",)),
    ]
    told = analyze(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")), "p_name", policies=mine).select("p_partkey", "analysis.*")
    return told.select("p_partkey", "decision", "highest_severity", F.array_join("matched_policy_codes", ",").alias("codes"), F.array_join("safe_detection_summary", "; ").alias("reasons"))


def _scores_by_length():
    """A stand-in for a classifier: sure of personal data where a text has an even number of characters."""
    return lambda window: {label: (0.9 if len(window) % 2 == 0 else 0.3) if label == "blocked_pii" else 0.4 if label == "allowed" else 0.1 for label in LABELS}


def _attack_by_word():
    """A stand-in for a guard: attacks name the word gizmo."""
    return (lambda text: text.split(), lambda ids: 0.95 if "gizmo" in ids else 0.2)


def _names_by_word():
    return lambda text: ["blue"] if "blue" in text else []


def model_stages(spark, sf_dir):
    """Guard, entity and classifier stages over texts that no rule blocks."""
    mine = [Policy("RULE", "credential", "high", "Rule", keywords=("red",)), Policy("PERSON", "pii", "low", "Person", keywords=("zzz",)), Policy("ATTACK", "prompt_injection", "critical", "Attack", keywords=("zzz",))]
    stages = [guard(_attack_by_word), entities(_names_by_word), classifier(_scores_by_length, 0.8, 512)]
    told = analyze(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")), "p_name", policies=mine, scorers=stages).select("p_partkey", "analysis.*")
    return told.select("p_partkey", "decision", "highest_severity", F.array_join("matched_policy_codes", ",").alias("codes"))


def adapted_cues(spark, sf_dir):
    """Text, label and error of raw rows of every shape, each with the name of a part in its text."""
    pick = lambda at: _case([row[at] for row in RAW_ROWS])
    raw = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("file"), pick(1).alias("source"), F.replace(pick(2), F.lit("{n}"), F.col("p_name")).alias("row"))
    found = prepare.adapt(raw.select("source", "file", F.lit("train").alias("original_split"), F.col("p_partkey").alias("ordinal"), "row"))
    return found.select(F.col("ordinal").alias("p_partkey"), F.col("file").alias("name"), "text", "label", "error")


def file_sources(spark, sf_dir):
    """Rows written as CSV, JSON lines, JSON and Parquet, and read again as raw rows of each source."""
    import uuid

    shared_checkpoints(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/sources-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('",\n'), "c_mktsegment").alias("text"))
    few = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_custkey"), F.col("n_name").alias("text"))
    rows.write.options(header=True, escape='"').csv(f"{folder}/csv")
    rows.write.json(f"{folder}/jsonl")
    rows.write.parquet(f"{folder}/parquet")
    few.agg(F.to_json(F.struct(F.lit("x").alias("note"), F.collect_list(F.struct("c_custkey", "text")).alias("records"))).alias("value")).write.text(f"{folder}/json")
    reads = {"csv": readers.read_csv, "jsonl": readers.read_jsonl, "parquet": readers.read_parquet, "json": readers.read_json}
    parts = [read(spark, f"{folder}/{name}", name) for name, read in reads.items()]
    raw = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return raw.select("source", "original_split", F.get_json_object("row", "$.c_custkey").cast("long").alias("key"), F.get_json_object("row", "$.text").alias("text"))


def manifest_check(spark, sf_dir):
    """Checksums of files against a manifest: right ones, wrong ones, unstated ones and missing files."""
    docs = _documents(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    right = F.sha2("content", 256)
    listed = docs.select("path", F.lit("train").alias("split"), F.when(F.col("doc_id") % 3 == 0, right).when(F.col("doc_id") % 3 == 1, F.lit("0")).alias("sha256"))
    out = readers.verify_manifest(docs.where("doc_id % 5 <> 0").select("path", "content"), listed)
    return out.select("path", "reason", "ok")


def request_gates(spark, sf_dir):
    """Prompts within the limits of a request that aren't blank; every seventh is white space only."""
    asked = _documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(" \t\n\u00A0\u2003")).otherwise(F.col("text")).alias("prompt"))
    return gateway.valid_prompts(asked).select("doc_id", F.length("prompt").cast("long").alias("characters"))


def identity_hashes(spark, sf_dir):
    """The keyed hashes that stand for addresses and users."""
    named = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("address"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("user"))
    return named.select("c_custkey", gateway.rate_identity(F.col("address"), "k1").alias("address_hash"), gateway.user_identity(F.col("user"), "k1").alias("user_hash"))


def page_decisions(spark, sf_dir):
    judged = analyze(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "html")
    return judged.select("page_id", F.col("analysis.decision").alias("decision"), F.array_join("analysis.matched_policy_codes", ",").alias("codes"))


def chunk_windows(spark, sf_dir):
    rows = chunks.chunked(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("offset").cast("long").alias("offset"), F.col("characters").cast("long").alias("characters"), F.sha2("chunk", 256).alias("chunk_sha256"))


def cross_turn_text(spark, sf_dir):
    joined = chunks.joined_units(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return joined.select("conv_id", F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("joined_sha256"))


def conversation_inspection(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    units = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("location"), "text")
    documents = units.select("doc").distinct().withColumn("issues", F.array().cast("array<string>"))
    report = chunks.inspect_units(units, documents)
    return report.select("doc", "decision", "complete", F.col("n_allowed").cast("long").alias("n_allowed"), F.col("n_blocked").cast("long").alias("n_blocked"))


def seed_merge(spark, sf_dir):
    """Seed a policy table that holds one of each part's own, two changed built-in ones and one with the earlier pattern."""
    from ..policies import EARLIER_PATTERNS

    mine = [Policy("EMAIL", "pii", "low", "Mine", enabled=False, regex_patterns=("x@y",)), Policy("PHONE", "pii", "low", "Old", regex_patterns=(EARLIER_PATTERNS["PHONE"],))]
    none, part = F.array().cast("array<string>"), table(spark, sf_dir, "part")
    own = part.select(
        F.concat(F.lit("PART_"), "p_partkey").alias("code"), F.col("p_name").alias("name"), F.lit("confidential_data").alias("category"), F.lit("").alias("description"), F.lit("low").alias("severity"),
        (F.col("p_size") > 10).alias("enabled"), F.array("p_name").alias("keywords"), none.alias("regex_patterns"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    out = seed(policy_frame(spark, mine).unionByName(own))
    return out.select("code", "category", "severity", "enabled", F.array_join("regex_patterns", "").alias("pattern"))


def topic_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "what is our ").when(F.col("p_partkey") % 3 == 1, "what is ").otherwise("tell me about the "), F.lower("p_type"), F.lit("?")).alias("q"))
    return asked.select("p_partkey", is_topic_question(F.col("q")).alias("topic"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    # a label is a few bytes: up to this many are sent to the texts, and no text is shuffled
    return docs.join(F.broadcast(labels) if labels.count() <= 2_000_000 else labels, "doc_id")


def _raw(spark, sf_dir) -> DataFrame:
    """Labelled documents as raw rows of a data set, with groups of five neighbours."""
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    both = _labelled(docs, labels)
    split = F.element_at(F.array(*[F.lit(x) for x in ("unspecified", "train", "validation", "test", "unspecified", "unspecified", "unspecified")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return both.select("doc_id", "text", "source", "toxic", split.alias("split"), F.concat(F.lit("g"), F.floor(F.col("doc_id") / 5).cast("string")).alias("group_id"))


def _adapted(spark, sf_dir) -> DataFrame:
    raw = _raw(spark, sf_dir)
    none = F.lit(None).cast("string")
    return raw.select("source", F.lit("documents").alias("file"), F.col("split").alias("original_split"), F.col("doc_id").alias("ordinal"), "text", prepare.binary_label(F.col("toxic")).alias("label"), "split", "group_id", none.alias("upstream_source"), F.col("doc_id").cast("string").alias("source_record_id"))


def label_adapter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy(prepare.binary_label(F.col("toxic")).alias("label"), F.col("quality")).agg(F.count("*").alias("n"))


def raw_row_adapter(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    rows = raw.select("source", F.lit("documents").alias("file"), F.col("split").alias("original_split"), F.col("doc_id").alias("ordinal"), F.to_json(F.struct(F.col("text").alias("prompt"), F.col("toxic").alias("is_injection"), "group_id")).alias("row"))
    found = prepare.adapt(rows)
    return found.select(F.col("ordinal").alias("doc_id"), "label", "split", "group_id", F.sha2("text", 256).alias("text_sha256"))


def split_buckets(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    split = prepare.split_for(F.col("source"), F.lit("unspecified"), F.sha2(F.col("doc_id").cast("string"), 256))
    return docs.groupBy("source", split.alias("split")).agg(F.count("*").alias("n"))


def dedupe_records(spark, sf_dir):
    found = prepare.records(_adapted(spark, sf_dir))
    return found.select("text_sha256", "label", "source", F.size("provenance").cast("long").alias("n_rows"), F.col("rank").cast("long").alias("rank"), "conflict", "duplicates")


def group_propagation(spark, sf_dir):
    shared_checkpoints(spark)
    done = prepare.propagate(prepare.records(_adapted(spark, sf_dir)))
    return done.select("text_sha256", "split", "conflict")


def provenance_filter(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))
    rows = _documents(spark, sf_dir).select("doc_id", F.struct(pick(["alpha", "pii-bench", "pii-trace", "bipia", "stef41"], 1).alias("source"), pick(["train", "valid", "test", "dev", "eval", "unspecified"], 5).alias("original_split"), pick(["train", "dev", "benchmark"], 30).alias("row_split")).alias("p"), pick(["train", "validation", "test"], 2).alias("split"))
    return rows.select("doc_id", "split", prepare.provenance_allowed(F.col("split"), F.col("p")).alias("allowed"))


def bipia_compose(spark, sf_dir):
    attacks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("attack"), F.lit("a.json").alias("file"), F.lit("c").alias("category"))
    contexts = prepare.numbered(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("i", F.col("html").alias("context"), F.lit("p.jsonl").alias("file"), F.col("page_id").alias("index"))
    return prepare.compose_bipia(attacks, contexts).select("turn", "label", "group_id", "source", "split", F.sha2("text", 256).alias("text_sha256"))


def _sampled(spark, sf_dir) -> DataFrame:
    return _raw(spark, sf_dir).select("doc_id", prepare.binary_label(F.col("toxic")).alias("label"), folded_digest(F.col("text")).alias("digest")).dropDuplicates(["digest"]).select("label", "digest")


def topk_per_label(spark, sf_dir):
    return evaluate.bounded_sample(_sampled(spark, sf_dir), {"allowed": 25}, 10)


def balanced_sample(spark, sf_dir):
    return evaluate.balanced_sample(_sampled(spark, sf_dir), 40).groupBy("label").agg(F.count("*").alias("n"), F.max("digest").alias("last"))


def leakage_check(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(folded_digest(F.col("text")).alias("digest"), "split")
    return evaluate.leaked(raw)


def _scores(spark, sf_dir) -> DataFrame:
    """Scores of seven classes as a stand-in for a classifier's: the first seven dimensions of an embedding, summing to 1."""
    size = F.transform(F.slice("embedding", 1, 7), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(size, F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("label") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", name.alias("label"), F.transform(size, lambda x: x / total).alias("scores"))


def single_threshold(spark, sf_dir):
    bar = evaluate.single_threshold(_scores(spark, sf_dir), 0.05)
    return spark.range(1).select(F.round(F.lit(bar), 6).alias("threshold"))


def calibrated_metrics(spark, sf_dir):
    out = evaluate.calibrated_metrics(_scores(spark, sf_dir), 0.5)
    return out.select(F.round("allowed_false_block_rate", 6).alias("allowed_false_block_rate"), F.round("blocked_recall", 6).alias("blocked_recall"), "allowed_count", "blocked_count")


def class_candidates(spark, sf_dir):
    out = evaluate.class_candidates(_scores(spark, sf_dir), 3, floor=0.2)
    return out.select("winner", "fp", "tp", F.round("score", 6).alias("score"))


def class_thresholds(spark, sf_dir):
    bars = evaluate.class_thresholds(_scores(spark, sf_dir), 0.05, floor=0.2)
    return spark.createDataFrame(sorted(bars.items()), "label string, threshold double").withColumn("threshold", F.round("threshold", 6))


def argmax_metrics(spark, sf_dir):
    out = evaluate.argmax_metrics(_scores(spark, sf_dir))
    return out.select("label", "rows", F.round("recall", 6).alias("recall"))


def _truth(spark, sf_dir, toxic: int | None = None) -> DataFrame:
    """Labelled documents with their decisions; of one value of toxic, if one is given. What has no such label isn't judged."""
    labels = table(spark, sf_dir, "labels")
    if toxic is not None:
        labels = labels.where(F.col("toxic") == toxic)
    docs = spread(_labelled(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), labels))
    return analyze(docs).drop("text")


def confusion(spark, sf_dir):
    rows = _truth(spark, sf_dir).select((F.col("analysis.decision") == "BLOCKED").alias("blocked"), (F.col("toxic") == 1).alias("truth"))
    out = evaluate.confusion(rows)
    return out.select("caught", "missed", "false_blocks", "passed", F.round("allowed_false_block_rate", 6).alias("allowed_false_block_rate"), F.round("blocked_recall", 6).alias("blocked_recall"))


def eval_by_source(spark, sf_dir):
    rows = _truth(spark, sf_dir)
    hit = (F.col("analysis.decision") == "BLOCKED").cast("long")
    return rows.groupBy("source", "toxic").agg(F.count("*").alias("n"), F.sum(hit).alias("blocked"))


def gateway_evaluation(spark, sf_dir):
    rows = _truth(spark, sf_dir).select(F.col("doc_id").alias("id"), prepare.binary_label(F.col("toxic")).alias("label"), "analysis")
    return evaluate.gateway_evaluation(rows)


def false_block_codes(spark, sf_dir):
    # an allowed row is one that isn't toxic
    return evaluate.false_block_codes(_truth(spark, sf_dir, toxic=0).withColumn("label", prepare.binary_label(F.col("toxic"))))


def false_block_sources(spark, sf_dir):
    rows = _truth(spark, sf_dir, toxic=0).withColumn("label", prepare.binary_label(F.col("toxic"))).withColumn("sources", F.array("source", F.concat(F.lit("lang "), "lang"), "source"))
    return evaluate.false_block_sources(rows)


def workbook_metrics(spark, sf_dir):
    # labels are joined after the texts are judged, so that this join moves no text
    docs = analyze_distinct(_documents(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("sha256"))).drop("text")
    action = F.when(F.col("toxic") == 1, "Block").when(F.col("toxic") == 0, "safe").otherwise("?")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("expected", evaluate.expected_decision(action))
    out = evaluate.workbook_metrics(rows.select("sha256", "expected", "analysis"))
    return out.withColumn("accuracy", F.round("accuracy", 6))


def _requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("identity"))


def rate_limit(spark, sf_dir):
    out = gateway.rate_limit(_requests(spark, sf_dir), order="event_id", limit=2, seconds=86_400)
    return out.select("event_id", "identity", "window_start", F.col("nth").cast("long").alias("nth"), "denied")


def training_counts(spark, sf_dir):
    """Train on the labelled documents, split by id, with seven classes from id and toxicity; the manifest's counts."""
    import uuid

    from ..operators.training import train
    from ..session import shared_dir

    name = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("doc_id") % 7 + 1).cast("int"))
    raw = _raw(spark, sf_dir).select("doc_id", "text", F.when(F.col("toxic") == 0, "allowed").otherwise(name).alias("label"), folded_digest(F.col("text")).alias("digest"))
    once = raw.groupBy("digest").agg(F.min(F.struct("doc_id", "text", "label")).alias("r")).select("digest", "r.*")
    bucket = F.col("doc_id") % 20
    split = F.when(bucket < 16, "train").when(bucket < 18, "validation").otherwise("test")
    none = F.array().cast("array<struct<source:string,original_split:string,row_split:string>>")
    splits = once.select(split.alias("split"), "text", "label", none.alias("provenance"))
    made = train(splits, f"{shared_dir(spark)}/model-{uuid.uuid4().hex}", caps={"train": 50, "validation": 40, "test": 30}, features=4096, max_iter=5)
    rows = [(s, label, n, made["selected_counts"][s][label]) for s, counts in made["source_counts"].items() for label, n in counts.items()]
    return spark.createDataFrame(rows, "split string, label string, source_count long, selected_count long")


def rate_limit_stream(spark, sf_dir):
    """The events as a stream, each decided from keyed state; what the stream has written, read again."""
    import uuid

    from ..session import shared_dir
    from ..streaming.limiter import limit_stream, write_decisions

    folder = f"{shared_dir(spark)}/limits-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    # a stream reads folders; a pattern takes a single file, too
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    source = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("identity"))
    write_decisions(limit_stream(source, order="event_id", limit=2, seconds=86_400), f"{folder}/decisions", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/decisions")
    return out.select("event_id", "identity", "window_start", F.col("nth").cast("long").alias("nth"), "denied")


def masked_documents(spark, sf_dir):
    """Addresses of mail and of machines masked in every document."""
    finder = pattern_finder({"EMAIL": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "IP_ADDRESS": r"[0-9]+(?:\.[0-9]+){3}"})
    out = mask(spread(_documents(spark, sf_dir).select("doc_id", "text")), finder)
    return out.select("doc_id", F.length("masked").cast("long").alias("characters"), F.sha2("masked", 256).alias("masked_sha256"))


def rate_counts(spark, sf_dir):
    return gateway.rate_counts(_requests(spark, sf_dir), limit=2, seconds=86_400)


def audit_page(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return gateway.audit_page(events, 3, 50, newest="ts", tie="event_id")


def audit_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    events = gateway.audit_events(analyze(gateway.valid_prompts(turns), "prompt"), created_at=F.lit("2026-01-01").cast("timestamp"), request_id=F.concat_ws("-", "conv_id", "turn"))
    return events.select("request_id", "prompt_hash", "decision", F.array_join("matched_policy_codes", ",").alias("codes"), "forwarded_to_llm")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_digest, prompt_hashes, sampling_digest, leet_compact, variant_counts, entropy_tokens, luhn_candidates,
        policy_hits, decisions, decision_summary, codes_by_lang, severity_rollup, reason_counts, page_decisions,
        chunk_windows, cross_turn_text, conversation_inspection, seed_merge, topic_questions, label_adapter,
        raw_row_adapter, split_buckets, dedupe_records, group_propagation, provenance_filter, bipia_compose, topk_per_label,
        balanced_sample, leakage_check, single_threshold, calibrated_metrics, class_candidates, class_thresholds,
        argmax_metrics, confusion, eval_by_source, gateway_evaluation, false_block_codes, false_block_sources, workbook_metrics, rate_limit,
        rate_limit_stream, masked_documents, training_counts,
        rate_counts, audit_page, audit_rows, policy_cues, variant_cues, own_policies, model_stages, adapted_cues,
        file_sources, manifest_check, request_gates, identity_hashes,
    )
}

"""The query catalogue: name -> callable(spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import conversions as conv
from tidemark.functions import keys as keyfn
from tidemark.functions.scalars import epoch_seconds, file_event_id
from tidemark.operators import apply as ap
from tidemark.operators import audit, fold, keyring, naming, ordering, project, reconcile, skew, validate
from tidemark.operators.store import KeyedTable
from tidemark.plans import fixtures as fx
from tidemark.session import configure, fresh_path, kept, remove
from tidemark.sources import cdc, landing, metadata, snapshot

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}

NOW = "1999-01-01 00:00:00"
RUN_ID = "run-1"
JOB = "applier"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(configure(spark), sf.rstrip("/"))

    CATALOGUE[fn.__name__] = run
    return fn


def n_rows(name: str = "row_count") -> Column:
    return F.count(F.lit(1)).alias(name)


# -- change files ---------------------------------------------------------------
@query
def landing_files(spark, sf):
    path = fresh_path(spark, "landing")
    fx.write_change_files(spark, sf, path)
    part = F.regexp_extract("file_path", r"part=(\d+)", 1).cast("bigint")
    return landing.pointers(landing.discover_files(spark, path)).select(
        part.alias("part"), "file_size", "retry_count", "is_retry")


@query
def cdc_parse(spark, sf):
    path = fresh_path(spark, "landing")
    fx.write_change_files(spark, sf, path)
    rows = cdc.read_cdc(spark, path, numbered=True)
    part = F.regexp_extract("file_name", r"part=(\d+)", 1).cast("bigint")
    data = F.col("data")
    return rows.select(part.alias("part"), "line_num", "op", "src_table", "src_schema", "event_ts",
                       F.size(data).cast("bigint").alias("n_data"),
                       *[F.get(data, F.lit(i)).alias(f"c{i + 1}") for i in range(3)])


@query
def cdc_markers(spark, sf):
    lines = cdc.classify(fx.cdc_lines(spark, sf))
    return lines.groupBy("kind").agg(n_rows("line_count"))


@query
def cdc_short_rows(spark, sf):
    return (cdc.rejected_rows(cdc.classify(fx.cdc_lines(spark, sf)))
            .select("file_name", "line_num", F.col("n_cols").cast("bigint").alias("n_cols"), "reason"))


@query
def cdc_header(spark, sf):
    return fx.cdc_rows(spark, sf).select("seq", "op", "src_table", "src_schema", "event_ts")


def _policy_group(spark) -> list[metadata.Mapping]:
    return metadata.by_source(fx.insurance(spark))["insurance.policy"]


def _claim_group(spark) -> list[metadata.Mapping]:
    return metadata.by_source(fx.insurance(spark))["insurance.claim"]


def _named_policy(spark, sf) -> DataFrame:
    return naming.name_columns(fx.cdc_rows(spark, sf), _policy_group(spark))


def _named_claim(spark, sf) -> DataFrame:
    return naming.name_columns(fx.cdc_rows(spark, sf), _claim_group(spark))


@query
def cdc_named(spark, sf):
    return _named_policy(spark, sf).drop("file_name", "line_num", "src_table", "src_schema")


def _fields(spark) -> DataFrame:
    return naming.primary_fields(fx.seed_maps(spark), fx.seed_rules(spark))


@query
def cdc_ragged(spark, sf):
    rows = fx.cdc_rows(spark, sf).withColumn("n_data", F.size("data").cast("bigint"))
    named = naming.named_map(rows, _fields(spark))
    width = F.size("event_data").cast("bigint")
    return named.select("seq", "src_table", width.alias("n_fields"),
                        F.greatest(width - F.col("n_data"), F.lit(0)).cast("bigint").alias("n_missing"),
                        F.greatest(F.col("n_data") - width, F.lit(0)).cast("bigint").alias("n_extra"),
                        F.try_element_at("event_data", F.lit("last_modified")).alias("last_modified"))


@query
def pk_extract(spark, sf):
    named = naming.key_map(naming.named_map(fx.cdc_rows(spark, sf), _fields(spark), keep_data=True))
    text = F.array_join(F.transform(F.map_entries("pk_values"),
                                    lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return named.select("seq", "src_table", text.alias("pk_text"))


@query
def cdc_unaddressed(spark, sf):
    return naming.unaddressed(fx.cdc_rows(spark, sf)).select("file_name", "line_num", "op", "src_schema")


@query
def unmapped_rows(spark, sf):
    rows = naming.unmapped(fx.cdc_rows(spark, sf), fx.seed_maps(spark))
    rows = rows.withColumn("event_id", file_event_id(F.col("file_name")))
    at = F.col("event_ts").try_cast("timestamp_ntz")
    reason = F.concat(F.lit("NO_MAPPINGS for "), naming.source_key())
    return audit.fault_rows(rows, JOB, F.lit(audit.STEP_MAP), F.lit(audit.FAILED), reason, at)


@query
def file_summary(spark, sf):
    out = ordering.file_summary(fx.cdc_rows(spark, sf))
    return out.select("file_name", "total_rows", F.array_join("tables_seen", ",").alias("tables_seen"))


def _ranked(spark, sf) -> DataFrame:
    ranks = metadata.dependency_ranks(fx.seed_maps(spark), fx.seed_rules(spark))
    return ordering.with_rank(fx.cdc_rows(spark, sf), ranks)


@query
def fk_order(spark, sf):
    ranked = _ranked(spark, sf).select("file_name", "line_num", "dep_rank")
    return ordering.fk_order(ranked, keep=kept).select(
        "file_name", "line_num", F.col("dep_rank").cast("bigint").alias("dep_rank"), "position")


@query
def files_reordered(spark, sf):
    return ordering.reordered_files(_ranked(spark, sf))


# -- metadata ---------------------------------------------------------------------
def _all_maps(spark, sf) -> DataFrame:
    return fx.wide_maps(spark, sf).unionByName(fx.seed_maps(spark))


def _all_rules(spark, sf) -> DataFrame:
    seeds = fx.seed_rules(spark).withColumn("rule_id", F.col("rule_id") - 1000)
    return fx.wide_rules(spark, sf).unionByName(seeds)


def _rule_text() -> Column:
    return F.array_join(F.transform("rules", lambda r: F.concat_ws(
        ":", r["src_field_name"], r["dstn_field_name"], r["conversion_method"])), ";")


@query
def meta_catalog(spark, sf):
    return metadata.catalog(_all_maps(spark, sf), _all_rules(spark, sf)).select(
        "map_id", "source", "load_order", "stream_type", F.size("rules").cast("bigint").alias("n_rules"),
        _rule_text().alias("rule_text"))


@query
def meta_lookup(spark, sf):
    got = metadata.lookup(_all_maps(spark, sf), _all_rules(spark, sf), fx.connections(spark, sf))
    return got.select("map_id", "src_tbl_nam", "dstn_tbl_nam", "connection_name", "db_type",
                      F.size("rules").cast("bigint").alias("n_rules"))


@query
def meta_lint(spark, sf):
    return metadata.lint(_all_maps(spark, sf), _all_rules(spark, sf))


@query
def meta_active(spark, sf):
    return metadata.active(_all_maps(spark, sf)).select("map_id", "src_tbl_nam", "load_order")


@query
def meta_stream(spark, sf):
    full = metadata.for_stream(metadata.active(_all_maps(spark, sf)), "FULL_LOAD")
    return full.select("map_id", "stream_type")


@query
def meta_patch(spark, sf):
    rules = _all_rules(spark, sf)
    keys = ["map_id", "src_field_name"]
    edits = rules.filter(F.col("src_field_name") == "f2").select(
        *keys, F.concat(F.lit("new_"), "dstn_field_name").alias("dstn_field_name"))
    deletes = rules.filter(F.col("src_field_name") == "f7").select(*keys)
    return metadata.patch(rules, keys, edits, ["dstn_field_name"], deletes).select(
        "rule_id", "map_id", "src_field_name", "dstn_field_name")


@query
def map_excluded(spark, sf):
    got = project.excluded_catalog(metadata.catalog(_all_maps(spark, sf), _all_rules(spark, sf)))
    return got.select("map_id", F.array_join("excluded", ",").alias("excluded"))


@query
def dep_rank(spark, sf):
    ranks = metadata.dependency_ranks(_all_maps(spark, sf), _all_rules(spark, sf))
    return ranks.withColumn("dep_rank", F.col("dep_rank").cast("bigint"))


@query
def fan_out(spark, sf):
    return naming.fan_out(fx.cdc_rows(spark, sf), fx.seed_maps(spark)).select(
        "seq", "op", "map_id", "dstn_tbl_nam", "load_order")


# -- projection and conversion -------------------------------------------------------
@query
def map_policy(spark, sf):
    main = _policy_group(spark)[0]
    return project.project_target(_named_policy(spark, sf), main, keep=["seq", "op"])


@query
def map_claim(spark, sf):
    main = _claim_group(spark)[0]
    return project.project_target(_named_claim(spark, sf), main, keep=["seq", "op"])


@query
def cast_target(spark, sf):
    named = _named_policy(spark, sf)
    date, money = F.col("effective_date"), F.col("premium_amount")
    return named.select(
        "seq", conv.cast_to_target(conv.convert("DIRECT", date), "DATE").alias("effective_date"),
        F.coalesce(conv.cast_fails(conv.convert("DIRECT", date), "DATE"), F.lit(False)).alias("bad_date"),
        conv.cast_to_target(conv.convert("NULL_TO_ZERO", money), "NUMERIC").alias("premium_amount"),
        conv.cast_fails(conv.convert("NULL_TO_ZERO", money), "NUMERIC").alias("bad_premium"))


@query
def conversions(spark, sf):
    rows = fx.cdc_rows(spark, sf)
    name, money, day = (F.get("data", F.lit(i)) for i in (2, 6, 7))
    return rows.select(
        "seq", conv.convert("DIRECT", money).alias("direct_value"),
        conv.convert("NULL_TO_BLANK", money).alias("blank_value"),
        conv.convert("NULL_TO_ZERO", money).cast("decimal(18,4)").alias("zero_value"),
        conv.unparsable_number(money).alias("zero_warning"),
        conv.convert("NULL_TO_DATE", day, "2001-02-03").alias("date_value"),
        conv.convert("NULL_TO_DATE", day, "no date").alias("date_fallback"),
        conv.convert("LEGACY_REF", F.get("data", F.lit(0))).alias("ref_value"),
        conv.convert("UPPERCASE", name).alias("upper_value"),
        conv.convert("TRIM", name).alias("trim_value"),
        conv.convert("SKIP_NULL_CONVERSION", money).alias("kept_value"),
        conv.convert("UUID_GENERATE", name).alias("uuid_value"),
        conv.convert(" unheard of ", money).alias("unknown_value"))


@query
def custom_conversion(spark, sf):
    conv.register_conversion("MASK_TAIL", lambda v, fmt: F.concat(
        F.lit("****"), F.right(v, F.lit(int(fmt or 4)))))
    named = _named_policy(spark, sf)
    return named.select("seq", conv.convert("mask_tail", F.col("policy_num"), "6").alias("masked"))


@query
def delete_keys(spark, sf):
    out = None
    rows = kept(fx.cdc_rows(spark, sf).filter(F.col("op") == "D"))  # all four targets read the lines parsed once
    for group in (_policy_group(spark), _claim_group(spark)):
        named = naming.name_columns(rows, group)
        for m in group:
            one = project.delete_keys(named, m, ["seq"]).select(
                "seq", F.lit(m.dst_table).alias("table_name"), F.col(m.dst_pks[0]).cast("string").alias("key_text"))
            out = one if out is None else out.unionByName(one)
    return out


@query
def validate_rows(spark, sf):
    rows = validate.target_rows(_named_policy(spark, sf), _policy_group(spark)[0], fx.POLICY, ["seq", "op"])
    return validate.invalid_rows(rows).select("seq", F.array_join("errors", ";").alias("errors"))


@query
def unique_violations(spark, sf):
    src = fx.policy_converted(spark, sf).select("policy_id", "policy_num")
    again = (src.filter(F.floor(F.col("policy_id") / 2) % 101 == 0)
             .select((F.col("policy_id") + 1).alias("policy_id"), "policy_num"))
    return validate.unique_violations(src.unionByName(again), ["policy_id"], "policy_num")


@query
def fk_violations(spark, sf):
    return validate.fk_violations(fx.claim_src(spark, sf).select("claim_id", "policy_id"), "policy_id",
                                  fx.policy_tgt(spark, sf), "policy_id")


# -- guard, last write wins, fold --------------------------------------------------------
FEED_SPEC = fold.FoldSpec(keys=("pk",), order=("seq",), values=("payload", "props", "last_modified"))


def _feed_rows(state: DataFrame) -> DataFrame:
    return fold.live(state).select("pk", "payload", "props", "last_modified",
                                   F.col("last_seq.seq").alias("last_seq"))


@query
def circular_guard(spark, sf):
    blocked = fold.circular_guard(F.col("datasync_flag"), F.col("op"))
    return fx.change_feed(spark, sf).select("seq", "op", "datasync_flag", blocked.alias("blocked"))


@query
def lww_decisions(spark, sf):
    decided = fold.decisions(fold.fold(fx.change_feed(spark, sf), FEED_SPEC))
    return decided.select("seq", "pk", "op", "decision")


@query
def apply_feed(spark, sf):
    return _feed_rows(fold.final_state(fold.fold(fx.change_feed(spark, sf), FEED_SPEC), FEED_SPEC))


@query
def apply_feed_split(spark, sf):
    """The same fold with every key treated as too heavy for one task."""
    feed = fx.change_feed(spark, sf)
    return _feed_rows(fold.final_state(fold.fold(feed, FEED_SPEC, task_rows=5), FEED_SPEC))


@query
def apply_replay(spark, sf):
    """The feed, then the whole feed once more as retries."""
    feed = fx.change_feed(spark, sf)
    spec = fold.FoldSpec(**{**FEED_SPEC.__dict__, "retried": "is_retry"})
    base = fold.final_state(fold.fold(feed, FEED_SPEC), FEED_SPEC)
    again = fold.fold(feed.withColumn("is_retry", F.lit(True)), spec, base)
    return _feed_rows(fold.final_state(again, spec))


@query
def apply_onto_base(spark, sf):
    """The later events of the feed onto the table the earlier ones left."""
    feed = fx.change_feed(spark, sf)
    early = F.to_date("event_ts") < F.lit("2024-01-11").cast("date")
    base = fold.final_state(fold.fold(feed.filter(early), FEED_SPEC), FEED_SPEC)
    return _feed_rows(fold.final_state(fold.fold(feed.filter(~early), FEED_SPEC, base), FEED_SPEC))


@query
def apply_defaults(spark, sf):
    feed = (fx.change_feed(spark, sf).withColumn("first_seq", F.col("seq"))
            .withColumn("account_uuid", keyfn.stable_uuid(F.col("seq").cast("string"))))
    spec = fold.FoldSpec(**{**FEED_SPEC.__dict__, "first": ("first_seq", "account_uuid")})
    return fold.live(fold.final_state(fold.fold(feed, spec), spec)).select(
        "pk", "payload", "first_seq", "account_uuid")


def _applied(spark, sf, which: str, rows: DataFrame | None = None) -> ap.Applied:
    group = _policy_group(spark) if which.startswith("policy") else _claim_group(spark)
    named = naming.name_columns(fx.cdc_rows(spark, sf) if rows is None else rows, group)
    mapping = next(m for m in group if m.dst_table == which)
    few = naming.name_columns(fx.cdc_rows(spark, sf, skew.sample_rate()), group)
    return ap.apply_one(named, mapping, fx.targets()[mapping.target], sample=few)


@query
def apply_upsert(spark, sf):
    return _applied(spark, sf, "policy").rows


@query
def apply_delete(spark, sf):
    gone = _applied(spark, sf, "policy").state.filter("is_deleted")
    return gone.select("policy_id", F.col("last_seq.seq").alias("last_seq"))


@query
def keyring_cdc(spark, sf):
    return _applied(spark, sf, "policy_keyring").rows.drop("keyring_id")  # numbered when stored


@query
def apply_isolated(spark, sf):
    done = ap.apply_isolated(fx.cdc_rows(spark, sf), fx.insurance(spark), fx.targets(),
                             sample=fx.cdc_rows(spark, sf, skew.sample_rate()), keep=kept)
    out = None
    for name, result in done.items():
        one = (result.events.groupBy("decision").agg(n_rows("event_count"))
               .select(F.lit(name).alias("table_name"), "decision", "event_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def apply_waves(spark, sf):
    t = fx.targets()
    policy, claim = _policy_group(spark)[0], _claim_group(spark)[0]
    path = fresh_path(spark, "rows")
    rows = kept(fx.cdc_rows(spark, sf), path)  # both tables are named from the same parsed lines
    p_spec, c_spec = ap.fold_spec(policy, t[policy.target]), ap.fold_spec(claim, t[claim.target])
    p_feed = ap.target_feed(naming.name_columns(rows, _policy_group(spark)), policy, t[policy.target])
    c_feed = ap.target_feed(naming.name_columns(rows, _claim_group(spark)), claim, t[claim.target])
    _, p_state, _, c_state = ap.apply_pair(
        (ap.deciding(p_feed, p_spec), p_spec, None), (ap.deciding(c_feed, c_spec), c_spec, None),
        fx.CLAIM.parent, kept, lambda: remove(spark, path))
    last = F.col("last_seq.seq").alias("last_seq")
    return (fold.live(p_state).select(F.lit("policy").alias("table_name"), F.col("policy_id").alias("id"), last)
            .unionByName(fold.live(c_state).select(
                F.lit("claim").alias("table_name"), F.col("claim_id").alias("id"), last)))


@query
def fk_restrict(spark, sf):
    rows = kept(fx.cdc_rows(spark, sf))  # both tables are named from the same parsed lines
    gone = project.delete_keys(naming.name_columns(rows, _policy_group(spark)), _policy_group(spark)[0])
    return validate.fk_restrict(gone, "policy_id", _applied(spark, sf, "claim", rows).rows, "policy_id")


# -- loads, keys and tokens -----------------------------------------------------------------
@query
def full_load(spark, sf):
    root = fresh_path(spark, "load")
    policy = KeyedTable(spark, f"{root}/policy", ["policy_id"])
    claim = KeyedTable(spark, f"{root}/claim", ["claim_id"])
    snapshot.initial_load([(fx.policy_converted(spark, sf), policy),
                           (fx.claim_src(spark, sf).drop("datasync_flag"), claim)])
    loaded = {"policy": policy.read(), "claim": claim.read()}
    snapshot.require_rows(loaded)
    return (loaded["claim"].join(loaded["policy"].select("policy_id", "policy_type", "premium_amount"), "policy_id")
            .groupBy("policy_type").agg(n_rows("claim_count"), F.sum("claim_amount").cast("decimal(18,2)").alias("claimed"),
                                        F.max("premium_amount").alias("top_premium")))


@query
def load_gate(spark, sf):
    return snapshot.load_gate({
        "policy": fx.policy_src(spark, sf), "claim": fx.claim_src(spark, sf),
        "nothing": fx.policy_src(spark, sf).filter("premium_amount < 0")})


@query
def key_origin(spark, sf):
    born = F.when(F.col("policy_num").endswith("-X"), "CLOUD")
    return keyring.origin_report(fx.policy_tgt(spark, sf).withColumn("flag", born), "policy_id", "flag")


def _cloud_new(spark, sf) -> DataFrame:
    fresh = fx.policy_src(spark, sf).filter("datasync_flag = 'CLOUD'").select(
        F.col("policy_id").alias("legacy_id"), "policy_num")
    return keyring.assign_keys(fresh, "legacy_id", "policy_id", 1000001)


@query
def assign_keys(spark, sf):
    return _cloud_new(spark, sf)


@query
def key_collisions(spark, sf):
    legacy, cloud = fx.policy_src(spark, sf), _cloud_new(spark, sf)
    hits = keyring.key_collisions(legacy, cloud, "policy_id").agg(n_rows()).select(
        F.lit("collisions").alias("table_name"), "row_count")
    return keyring.table_counts({"legacy": legacy, "cloud": cloud}).unionByName(hits)


@query
def binary_key(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 50 == 0, F.hex(k)).otherwise(F.lpad(F.hex(k), 18, "0"))
    keys = fx.table(spark, sf, "orders").select("o_orderkey", text.alias("given"))
    raw = keyfn.text_to_clock_key(F.col("given"))
    return keys.select("o_orderkey", raw.isNotNull().alias("is_valid"),
                       F.octet_length(raw).cast("bigint").alias("n_bytes"),
                       keyfn.clock_key_to_text(raw).alias("round_trip"))


def _policy_ring(spark, sf) -> DataFrame:
    """Keyring after two loads: the numbers of the drifted copy, then all others."""
    old = keyring.keyring_load(fx.policy_tgt(spark, sf), "policy_num", None, "legacy_policy_num",
                               "policy_uuid", "policy_id", 4000001, fx.TOKEN_SALT)
    new = keyring.keyring_load(fx.policy_src(spark, sf), "policy_num", old, "legacy_policy_num",
                               "policy_uuid", "policy_id", 4000001, fx.TOKEN_SALT)
    return old.unionByName(new)


def _claim_ring(spark, sf) -> DataFrame:
    return keyring.keyring_load(fx.claim_src(spark, sf), "claim_num", None, "legacy_claim_num",
                                "claim_uuid", "claim_id", 3000001, fx.TOKEN_SALT)


@query
def keyring_load(spark, sf):
    return _policy_ring(spark, sf)


@query
def keyring_counts(spark, sf):
    return keyring.table_counts({
        "policy": fx.policy_src(spark, sf), "policy_keyring": _policy_ring(spark, sf),
        "claim": fx.claim_src(spark, sf), "claim_keyring": _claim_ring(spark, sf)})


@query
def keyring_gaps(spark, sf):
    ring = fx.policy_tgt(spark, sf).select(F.col("policy_num").alias("legacy_policy_num"))
    return keyring.keyring_gaps(fx.policy_src(spark, sf), "policy_num", ring, "legacy_policy_num")


@query
def token_lookup(spark, sf):
    """The reference's own report shows three rows."""
    ring = _policy_ring(spark, sf).select(F.col("legacy_policy_num").alias("policy_num"), "policy_uuid")
    return fx.policy_src(spark, sf).select("policy_num").join(ring, "policy_num").orderBy("policy_num").limit(3)


def _tokens(spark, sf) -> DataFrame:
    nums = fx.policy_src(spark, sf).select(F.col("policy_num").alias("legacy_policy_num"))
    return nums.withColumn("policy_uuid", keyfn.stable_uuid(F.col("legacy_policy_num"), fx.TOKEN_SALT))


def _tokenised(spark, sf) -> DataFrame:
    claims = fx.claim_src(spark, sf).select("claim_id", "policy_num", "claim_amount")
    return keyring.tokenise(claims, "policy_num", _tokens(spark, sf), "legacy_policy_num", "policy_uuid")


@query
def tokenise(spark, sf):
    return _tokenised(spark, sf)


@query
def detokenise(spark, sf):
    return keyring.detokenise(_tokenised(spark, sf), "policy_uuid", _tokens(spark, sf),
                              "legacy_policy_num", "policy_num")


# -- outcomes, audit, retry -------------------------------------------------------------------
def _outcomes(spark, sf) -> DataFrame:
    """Events with status; a payload above 100 is refused by the target."""
    feed = (fx.change_feed(spark, sf)
            .withColumn("retry_count", (F.col("seq") % 3).cast("int"))
            .withColumn("ok", F.col("payload") <= 100)
            .withColumn("file_name", F.concat(F.lit("feed_"), F.col("event_ts").cast("date").cast("string")))
            .withColumn("applied_at", F.col("event_ts") + F.make_dt_interval(secs=(F.col("seq") * 7 % 90).cast("decimal(18,6)")))
            .withColumn("error_message", F.when(F.col("payload") > 100, F.concat(
                F.lit("payload out of range: "), F.repeat(F.col("payload").cast("string"), 120)))))
    feed = feed.withColumn("event_id", file_event_id(F.col("file_name")))
    spec = fold.FoldSpec(**{**FEED_SPEC.__dict__, "valid": "ok"})
    return audit.with_status(fold.decisions(fold.fold(feed, spec)))


def _audit(spark, sf, outcomes: DataFrame | None = None) -> DataFrame:
    data = {"pk": F.col("pk"), "seq": F.col("seq"), "payload": F.col("payload"), "props": F.col("props"),
            "datasync_flag": F.col("datasync_flag"), "last_modified": F.col("last_modified")}
    out = _outcomes(spark, sf) if outcomes is None else outcomes
    return audit.audit_rows(out, data, "app", "account", 9, F.col("applied_at"))


def _flat_audit(rows: DataFrame) -> DataFrame:
    data = F.col("event_data")
    return rows.select(
        "event_id", "table_name", F.col("event_metadata.operation").alias("operation"),
        data["seq"].cast("bigint").alias("seq"), data["payload"].alias("payload"),
        F.try_element_at(data, F.lit("datasync_flag")).alias("flag"),
        F.size(data).cast("bigint").alias("n_fields"), "map_id", "status", "retry_count", "reprocess_flag",
        "ttl_epoch", "created_at", F.length("error_message").cast("bigint").alias("error_chars"))


@query
def status_decision(spark, sf):
    return _outcomes(spark, sf).select("seq", "decision", "status", "retry_count")


@query
def audit_log(spark, sf):
    return _flat_audit(_audit(spark, sf))


def _utilization(spark, sf) -> DataFrame:
    return audit.outcome_utilization(_outcomes(spark, sf), JOB, F.col("applied_at"))


def _faults(spark, sf) -> DataFrame:
    return audit.outcome_faults(_outcomes(spark, sf), JOB, F.col("applied_at"))


@query
def utilization(spark, sf):
    return _utilization(spark, sf)


@query
def faults(spark, sf):
    return _faults(spark, sf)


@query
def dead_letters(spark, sf):
    return audit.dead_letters(_outcomes(spark, sf)).select(
        "event_id", "seq", "op", "src_schema", "src_table", "retry_count", "is_retry")


@query
def retry_plan(spark, sf):
    letters = _outcomes(spark, sf).filter(F.col("status").isin(audit.FAILED, audit.PERMANENT))
    return audit.retry_plan(letters).select("seq", "retry_count", "action")


@query
def retry_totals(spark, sf):
    letters = _outcomes(spark, sf).filter(F.col("status").isin(audit.FAILED, audit.PERMANENT))
    return audit.plan_totals(audit.retry_plan(letters))


@query
def audit_current(spark, sf):
    rows = _audit(spark, sf).withColumn("seq", F.col("event_data")["seq"].cast("bigint"))
    return _flat_audit(audit.audit_current(rows, ["created_at", "seq"]))


@query
def audit_retention(spark, sf):
    now = epoch_seconds(F.lit("2024-04-10 12:00:00").cast("timestamp_ntz"))
    kept = audit.retained(_audit(spark, sf), now)
    return kept.groupBy("status").agg(n_rows("kept"), F.min("ttl_epoch").alias("first_ttl"))


@query
def reprocess_feed(spark, sf):
    rows = _audit(spark, sf)
    flagged = rows.withColumn("reprocess_flag", (F.col("status") == audit.PERMANENT)
                              & (F.col("event_data")["seq"].cast("bigint") % 2 == 0))
    return audit.reprocess_feed(flagged, {
        "seq": "bigint", "pk": "bigint", "payload": "decimal(12,2)", "props": "string",
        "datasync_flag": "string", "last_modified": "timestamp_ntz"}).drop("event_id")


@query
def step_trace(spark, sf):
    read = _outcomes(spark, sf).select("event_id", "applied_at").groupBy("event_id").agg(
        F.max("applied_at").alias("applied_at"))
    first = audit.utilization_rows(read, JOB, F.lit(audit.STEP_READ), F.lit(audit.SUCCESS), F.col("applied_at"))
    return audit.step_trace(_utilization(spark, sf).unionByName(first), _faults(spark, sf))


@query
def status_counts(spark, sf):
    return audit.status_counts(_outcomes(spark, sf))


@query
def guard_scoreboard(spark, sf):
    return audit.guard_scoreboard(_outcomes(spark, sf), ["file_name"])


@query
def sla_report(spark, sf):
    latency = F.col("seq") * 7 % 90
    failed = F.col("status").isin(audit.FAILED, audit.PERMANENT)
    return audit.sla_report(_outcomes(spark, sf), ["op"], latency, failed)


# -- reconciliation ------------------------------------------------------------------------------
COMPARED = ["policy_num", "policy_holder_name", "policy_type", "premium_amount", "last_modified"]


def _compared(spark, sf) -> DataFrame:
    return reconcile.compare(fx.policy_converted(spark, sf), fx.policy_tgt(spark, sf), "policy_id", COMPARED)


@query
def recon_counts(spark, sf):
    return reconcile.counts({
        "policy": (fx.policy_converted(spark, sf), fx.policy_tgt(spark, sf)),
        "claim": (fx.claim_src(spark, sf), fx.claim_src(spark, sf).filter("incident_date is not null"))})


@query
def recon_missing(spark, sf):
    return reconcile.missing(fx.policy_converted(spark, sf), fx.policy_tgt(spark, sf), "policy_id").select(
        "policy_id", "policy_num")


@query
def recon_orphans(spark, sf):
    return reconcile.orphans(fx.policy_converted(spark, sf), fx.policy_tgt(spark, sf), "policy_id").select(
        "policy_id", "policy_num")


@query
def recon_rows(spark, sf):
    return _compared(spark, sf).drop("src", "tgt")


@query
def recon_digest(spark, sf):
    """What differs, found by digests of parts of the key space."""
    return reconcile.compare_by_digest(
        fx.policy_converted(spark, sf), fx.policy_tgt(spark, sf), "policy_id", COMPARED).drop("src", "tgt")


@query
def recon_drift(spark, sf):
    found = reconcile.discrepancies(_compared(spark, sf))
    return reconcile.drift(found, "policy_id", "last_modified", F.lit(NOW).cast("timestamp_ntz"))


def _repair(spark, sf) -> DataFrame:
    found = reconcile.discrepancies(_compared(spark, sf))
    return reconcile.repair_feed(found, "policy_id", COMPARED, "last_modified")


@query
def recon_repair(spark, sf):
    return _repair(spark, sf)


@query
def recon_history(spark, sf):
    """Every discrepancy, stored under its run and read back."""
    return _drift_table(spark, sf).read().withColumn("run_id", F.col("run_id").cast("string"))


def _drift_table(spark, sf) -> reconcile.DriftTable:
    table = reconcile.DriftTable(spark, fresh_path(spark, "drift"))
    found = reconcile.discrepancies(_compared(spark, sf))
    table.append(reconcile.history_rows(found, "insurance.policy", "policy_id", RUN_ID), RUN_ID)
    return table


@query
def recon_alert(spark, sf):
    """Counts from the stored run, which the alert names."""
    stored = _drift_table(spark, sf).read().withColumn("run_id", F.col("run_id").cast("string"))
    return reconcile.alert_rows(stored)


@query
def recon_converged(spark, sf):
    """The target after the repair feed, compared again."""
    spec = fold.FoldSpec(keys=("policy_id",), order=("seq",), values=tuple(COMPARED))
    base = fx.policy_tgt(spark, sf).withColumn("last_seq", F.struct(F.lit(0).cast("bigint").alias("seq"))) \
        .withColumn("is_deleted", F.lit(False))
    feed = _repair(spark, sf).withColumn("seq", F.lit(1).cast("bigint"))
    healed = fold.live(fold.final_state(fold.fold(feed, spec, base), spec))
    again = reconcile.compare(fx.policy_converted(spark, sf), healed, "policy_id", COMPARED)
    return again.groupBy("verdict").agg(n_rows())


def catalogue() -> dict[str, Query]:
    from tidemark.plans import streams  # noqa: F401  (adds the streaming queries)
    return dict(CATALOGUE)

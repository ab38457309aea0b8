"""Review plans, their contexts, proposal checks, adjudication and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.schemas import ROLE_SCOPES, ROLES

BLOCKERS = ("model_abstained", "model_confidence_below_threshold", "rules_role_unresolved", "model_role_unresolved", "role_disagreement", "scope_unresolved", "scope_disagreement")


def context_window(blocks: DataFrame, partition: str, radius: int = 2, keep: int = 2) -> DataFrame:
    """(partition, ord, context_ord, score, reason): the best ``keep`` neighbours of each block, and its parent heading.

    ``blocks``: (partition, ord, text, styled, parent_ord or null). Neighbours come from lags and leads, so that no
    range join is needed; of equal scores the nearer wins, then the parent, then the one before.
    """
    order = Window.partitionBy(partition).orderBy("ord")
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""
    facts = F.struct("ord", blank(F.col("text")).alias("blank"), "styled")
    near = []
    for d in range(1, radius + 1):
        for step, (where, reason) in enumerate(((F.lag, "previous"), (F.lead, "next"))):
            x = where(facts, d).over(order)
            near.append(F.when(x.isNotNull() & ~x["blank"], F.struct((F.lit(60 - 10 * d) + F.when(x["styled"], 15).otherwise(0)).alias("score"), x["ord"].alias("context_ord"), F.lit(reason).alias("reason"), F.lit(d).alias("distance"), F.lit(2 * d + step).alias("seq"))))
    rows = blocks.withColumn("_near", F.array_compact(F.array(*near)))
    heads = blocks.select(F.col(partition).alias("_p"), F.col("ord").alias("_o"), blank(F.col("text")).alias("_b"))
    parent = rows.where("parent_ord is not null and parent_ord <> ord").join(heads, (F.col(partition) == F.col("_p")) & (F.col("parent_ord") == F.col("_o"))).where("not _b")
    parent = parent.select(partition, "ord", F.struct(F.lit(80).alias("score"), F.col("parent_ord").alias("context_ord"), F.lit("parent_heading").alias("reason"), F.abs(F.col("parent_ord") - F.col("ord")).cast("int").alias("distance"), F.lit(0).alias("seq")).alias("x"))
    all_ = rows.select(partition, "ord", F.explode("_near").alias("x")).unionByName(parent)
    best = all_.groupBy(partition, "ord", F.col("x.context_ord").alias("context_ord")).agg(F.max_by("x", F.struct(F.col("x.score"), -F.col("x.seq"))).alias("x"))
    rank = F.row_number().over(Window.partitionBy(partition, "ord").orderBy(F.desc("x.score"), "x.distance", "x.seq"))
    return best.withColumn("_n", rank).where(F.col("_n") <= keep).select(partition, "ord", "context_ord", F.col("x.score").alias("score"), F.col("x.reason").alias("reason"))


def review_plan(blocks: DataFrame) -> DataFrame:
    """Adds ``skip_reason`` to review targets: objects that cannot be shown, kinds without roles, blocks without text."""
    kind = F.col("kind")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit("")) == ""
    reason = F.when(F.col("unsupported"), "unsupported_object").when(~kind.isin("paragraph", "table", "table_cell"), "unsupported_kind").when(blank, "no_text_evidence")
    return blocks.withColumn("skip_reason", reason)


def proposal_violations(proposals: DataFrame, packets: DataFrame) -> DataFrame:
    """Adds ``violation`` (null if none): the first check that a proposal fails against its packet."""
    packet = packets.select("packet_id", *[F.col(c).alias(f"p_{c}") for c in ("target", "text_sha256", "allowed_roles", "allowed_scopes", "context_ids")])
    allowed = F.create_map(*[x for r, s in ROLE_SCOPES.items() for x in (F.lit(r), F.array(*map(F.lit, s)))])
    outside = lambda a, x: ~F.coalesce(F.array_contains(a, x), F.lit(False))
    code = (
        F.when(F.col("p_target").isNull() | (F.col("p_target") != F.col("target")), "other_packet")
        .when(F.col("p_text_sha256") != F.col("text_sha256"), "stale_text_hash")
        .when(F.col("abstained"), F.lit(None))
        .when(F.col("role").isNull(), "role_omitted")
        .when(outside(F.col("p_allowed_roles"), F.col("role")), "role_not_allowed")
        .when(F.col("scope").isNotNull() & outside(F.col("p_allowed_scopes"), F.col("scope")), "scope_not_allowed")
        .when(F.col("scope").isNotNull() & outside(allowed[F.col("role")], F.col("scope")), "scope_incompatible")
        .when(F.size(F.array_except("evidence_ids", "p_context_ids")) > 0, "evidence_outside_context")
    )
    return proposals.join(packet, "packet_id", "left").withColumn("violation", code).drop(*[c for c in packet.columns if c.startswith("p_")])


def unique_scope(role: Column, scope: Column) -> Column:
    """The scope, or the only one that the role can have."""
    single = F.create_map(*[F.lit(x) for r, s in ROLE_SCOPES.items() if len(s) == 1 for x in (r, s[0])])
    return F.coalesce(scope, single[role])


def adjudicate(packets: DataFrame, proposals: DataFrame, key: list[str], threshold: float = 0.9, given: bool = False) -> DataFrame:
    """Rules against model: accepted only where nothing speaks against it.

    ``packets``: (key, rules_role, rules_scope); ``proposals``: (key, model_role, model_scope, confidence, abstained).
    Adds outcome, reasons, selected_role, selected_scope; with ``given`` also what both said, as a struct, so that it need
    not be joined again.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    rows = packets.join(proposals.withColumn("_proposed", F.lit(True)), key, "left")
    rows = rows.withColumns({"_rs": unique_scope(F.col("rules_role"), F.col("rules_scope")), "_ms": unique_scope(F.col("model_role"), F.col("model_scope"))})
    made = F.col("_proposed").isNotNull()
    open_ = lambda r: F.coalesce(F.col(r), F.lit("unknown")) == "unknown"
    scoped = F.col("_rs").isNotNull() & F.col("_ms").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("rules_scope").isNull() & F.col("_rs").isNotNull(), "rules_scope_derived_from_unique_role_scope"), F.when(~made, "model_proposal_missing"),
        F.when(made & F.col("model_scope").isNull() & F.col("_ms").isNotNull(), "model_scope_derived_from_unique_role_scope"), F.when(made & F.col("abstained"), "model_abstained"),
        F.when(made & (F.col("confidence") < threshold), "model_confidence_below_threshold"), F.when(made & open_("rules_role"), "rules_role_unresolved"), F.when(made & open_("model_role"), "model_role_unresolved"),
        F.when(made & ~F.col("rules_role").eqNullSafe(F.col("model_role")), "role_disagreement"), F.when(made & ~scoped, "scope_unresolved"), F.when(made & scoped & (F.col("_rs") != F.col("_ms")), "scope_disagreement"),
    ))
    rows = rows.withColumn("_reasons", reasons)
    blocked = ~made | F.arrays_overlap("_reasons", F.array(*map(F.lit, BLOCKERS)))
    rows = rows.withColumn("outcome", F.when(blocked, "manual_review").otherwise("auto_accept"))
    accepted = F.col("outcome") == "auto_accept"
    rows = rows.withColumns({"reasons": F.when(accepted, F.array_append("_reasons", F.lit("rules_and_model_agree"))).otherwise(F.col("_reasons")), "selected_role": F.when(accepted, F.col("model_role")), "selected_scope": F.when(accepted, F.col("_ms"))})
    said = [F.struct("rules_role", F.col("_rs").alias("rules_scope"), "model_role", "model_scope", "abstained", F.col("_proposed").isNotNull().alias("proposed")).alias("given")] if given else []
    return rows.select(*key, "outcome", "reasons", "selected_role", "selected_scope", F.col("_rs").alias("rules_scope"), F.col("_ms").alias("model_scope"), *said)


def adjudication_counts(decisions: DataFrame) -> DataFrame:
    """targets, auto_accept, manual_review."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return decisions.agg(F.count("*").alias("targets"), n("auto_accept"), n("manual_review"))


def review_targets(decisions: DataFrame, mode: str) -> DataFrame:
    """The blocks that a plan asks about: review roots with what rules say of them, or all top blocks without it."""
    from foliary.operators.classify import review_roots

    if mode == "hybrid":
        roots = review_roots(decisions).select("doc_id", "block_id")
        return decisions.join(roots, ["doc_id", "block_id"], "left_semi")
    if mode != "prompt_only":
        raise ValueError("ai_mode_mismatch")
    return decisions.where("container_id is null").withColumns({c: F.lit(None).cast("string") for c in ("role", "scope")})


def packets(targets: DataFrame, excerpts: DataFrame, mode: str) -> DataFrame:
    """A packet per target that can be asked about, its context nested in reading order: packet_id, doc_id, target,
    text_sha256, allowed_roles, allowed_scopes, rules_role, rules_scope, context, context_ids.

    ``targets``: doc_id, ord, block_id, kind, text, text_sha256, role, scope, unsupported; ``excerpts``: doc_id, ord,
    context_ord, context_id, reason, excerpt, truncated. A target's context is bounded by the window's size.
    """
    asked = review_plan(targets).where("skip_reason is null")
    one = F.struct("context_ord", F.col("context_id").alias("block_id"), "reason", "excerpt", "truncated")
    near = excerpts.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(one)).alias("context"))
    table = F.col("kind") == "table"
    tables = ["table", "abbreviation_table", "unknown"]
    roles = F.when(table, F.array(*map(F.lit, tables))).when(F.col("kind") == "table_cell", F.array(F.lit("table_text"), F.lit("unknown"))).otherwise(F.array(*[F.lit(r) for r in ROLES if r not in (*tables, "table_text", "figure")], F.lit("unknown")))
    allowed = F.create_map(*[x for r, s in ROLE_SCOPES.items() for x in (F.lit(r), F.array(*map(F.lit, s)))])
    scopes = F.array_distinct(F.flatten(F.transform("allowed_roles", lambda r: F.coalesce(allowed[r], F.array().cast("array<string>")))))
    rows = asked.join(near, ["doc_id", "ord"], "left").withColumn("allowed_roles", roles).withColumn("allowed_scopes", scopes)
    context = F.coalesce("context", F.array().cast("array<struct<context_ord:long,block_id:string,reason:string,excerpt:string,truncated:boolean>>"))
    rows = rows.withColumn("context", context)
    ids = F.array_distinct(F.concat(F.array("block_id"), F.transform("context", lambda c: c["block_id"])))
    return rows.select(F.concat_ws("-", F.lit(mode), "block_id").alias("packet_id"), "doc_id", F.col("block_id").alias("target"), "text_sha256", "allowed_roles", "allowed_scopes", F.col("role").alias("rules_role"), F.col("scope").alias("rules_scope"), "context", ids.alias("context_ids"))


def plan_totals(targets: DataFrame, made: DataFrame) -> DataFrame:
    """candidates, packets, skipped, context_characters of a plan, by document."""
    asked = targets.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    size = F.aggregate("context", F.lit(0).cast("long"), lambda s, c: s + F.char_length(c["excerpt"]))
    sent = made.groupBy("doc_id").agg(F.count("*").alias("packets"), F.sum(size).alias("context_characters"))
    rows = asked.join(sent, "doc_id", "left").na.fill(0, ["packets", "context_characters"])
    return rows.withColumn("skipped", F.col("candidates") - F.col("packets"))


def run_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a model run from calls (by, ok, input_tokens, output_tokens, total_tokens or null, elapsed_ms, cost or null)."""
    done = F.count_if("ok")
    tokens = F.sum(F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")))
    known = F.count_if(F.col("cost").isNull()) == 0
    status = F.when(done == F.count("*"), "completed").when(done == 0, "failed").otherwise("partial")
    return calls.groupBy(*by).agg(done.alias("completed"), F.count_if(~F.col("ok")).alias("failed"), status.alias("status"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), tokens.alias("total_tokens"), F.sum("elapsed_ms").alias("elapsed_ms"), F.when(known, F.sum("cost")).alias("cost"))


def context_excerpts(context: DataFrame, blocks: DataFrame, partition: str, most: int = 240) -> DataFrame:
    """The context's texts, cut to ``most`` characters by their place."""
    from foliary.functions.text import collapsed, excerpt

    texts = blocks.select(partition, F.col("ord").alias("context_ord"), "text")
    rows = context.join(texts, [partition, "context_ord"])
    return rows.withColumns({"excerpt": excerpt(F.col("text"), F.col("reason"), most), "truncated": F.char_length(collapsed(F.col("text"))) > most}).drop("text")

"""Win-back campaign jobs and the conversation tables.

Two idempotent batch jobs replace the interrupt/resume workflow:
``campaign_build`` (serving tables → one draft row) and
``campaign_decisions`` (drafts ⊕ append-only decision log → status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.labels import DISCOUNT_TIERS
from retailspark.functions.rank import SortKey, with_global_rank
from retailspark.operators.insight import _fill, money, pct

# ---- fixed values: campaign copy template -----------------------------------
BRIEF_HEADLINE = "喚醒 {count} 位沉睡的高價值客戶"
BRIEF_MESSAGE = "這群客戶平均終身價值 {clv},平均折扣 {disc},值得專屬的挽回活動。"
SELLING_POINTS = ("依個人終身價值分層的折扣", "搭配客戶最常購買商品的推薦", "限時喚醒沉睡客戶")
STATUSES = ("pending", "approved", "rejected", "revised")
ROLES = ("human", "ai", "tool")


def discount_tiers(candidates: DataFrame) -> DataFrame:
    """Rank by (predicted_clv desc, customer_id): thirds → 20 / 15 / 10 %."""
    r = with_global_rank(candidates, [SortKey("predicted_clv", False), SortKey("customer_id")], "_r")
    n = max(1, r.count())
    tier = F.floor((F.col("_r") - 1) * 3 / F.lit(n)).cast("int")
    tiers = F.array(*[F.lit(t) for t in DISCOUNT_TIERS])
    return r.withColumn("discount", F.element_at(tiers, tier + 1)).drop("_r")


def match_offers(candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """Best offer (rank 1) per candidate, NULL if none — one left join."""
    best = offers.filter(F.col("rank") == 1).select("customer_id", F.col("consequents").alias("offer"))
    return candidates.join(best, "customer_id", "left")


def campaign_revision(candidates: DataFrame, excluded: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drop excluded ids (anti join), apply reviewer discounts (left join)."""
    kept = candidates.join(excluded.select("customer_id"), "customer_id", "left_anti")
    o = overrides.select("customer_id", F.col("discount").alias("_override"))
    return (kept.join(o, "customer_id", "left")
            .withColumn("discount", F.coalesce(F.col("_override"), F.col("discount")))
            .drop("_override"))


def campaign_summary(candidates: DataFrame) -> DataFrame:
    seg_counts = candidates.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    by_seg = seg_counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", "n"))))
                            .alias("by_segment"))
    tot = candidates.agg(F.count(F.lit(1)).alias("count"),
                         F.sum("predicted_clv").alias("_clv"), F.sum("discount").alias("_d"))
    one = tot.withColumn("_k", F.lit(1)).join(by_seg.withColumn("_k", F.lit(1)), "_k", "left")
    return one.select(
        "count",
        F.when(F.col("count") > 0, F.round(F.col("_clv") / F.col("count"), 2)).otherwise(0.0)
         .alias("avg_predicted_clv"),
        F.when(F.col("count") > 0, F.round(F.col("_d") / F.col("count"), 4)).otherwise(0.0)
         .alias("avg_discount"),
        F.coalesce(F.col("by_segment"), F.create_map().cast("map<string,bigint>")).alias("by_segment"))


def campaign_brief(summary: DataFrame) -> DataFrame:
    return summary.select(
        "*",
        _fill(BRIEF_HEADLINE, count=F.col("count")).alias("headline"),
        _fill(BRIEF_MESSAGE, clv=money(F.col("avg_predicted_clv")),
              disc=pct(F.col("avg_discount"))).alias("message"),
        F.array(*[F.lit(s) for s in SELLING_POINTS]).alias("selling_points"))


def campaign_candidates(candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """Tiered, offer-matched candidate rows (kept as a table keyed by
    customer, not folded into one draft value)."""
    return match_offers(discount_tiers(candidates), offers).select(
        "customer_id", "segment", "predicted_clv", "discount", "offer")


def grouped_briefs(candidates: DataFrame) -> DataFrame:
    """approval_id → candidate_count and brief (JSON) of its candidates."""
    tot = candidates.groupBy("approval_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum("predicted_clv") / F.count(F.lit(1)), 2).alias("avg_predicted_clv"),
        F.round(F.sum("discount") / F.count(F.lit(1)), 4).alias("avg_discount"))
    return campaign_brief(tot).select(
        "approval_id", F.col("count").alias("candidate_count"),
        F.to_json(F.struct("headline", "message", "selling_points")).alias("brief"))


#: Candidates of one chunk of a draft document, on average.
CHUNK_CANDIDATES = 5_000
_DRAFT_HEAD = "headline string, message string, selling_points array<string>, count bigint"
_DRAFT_CANDIDATE = "customer_id string, segment string, predicted_clv double, discount double, offer string"


def draft_document(candidates: DataFrame, each: int = CHUNK_CANDIDATES) -> DataFrame:
    """The drafts of ``candidates`` as chunked JSON documents: approval_id,
    chunk, chunks, document.

    Chunk 0 is the head (headline, message, selling points, count); chunks 1 to
    ``chunks`` - 1 are JSON arrays of candidates in order of customer_id.  A
    candidate's chunk follows from a hash of its customer_id, so a chunk holds
    about ``each`` however many candidates a draft has, and no draft stands
    whole in one task or one string.  Empty chunks are not written, nor is a
    draft without candidates.
    """
    tot = candidates.groupBy("approval_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum("predicted_clv") / F.count(F.lit(1)), 2).alias("avg_predicted_clv"),
        F.round(F.sum("discount") / F.count(F.lit(1)), 4).alias("avg_discount"))
    sizes = tot.select("approval_id", (F.lit(1) + F.ceil(F.col("count") / each)).cast("int").alias("chunks"))
    head = campaign_brief(tot).join(sizes, "approval_id").select(
        "approval_id", F.lit(0).alias("chunk"), "chunks",
        F.to_json(F.struct("headline", "message", "selling_points", "count")).alias("document"))
    place = F.pmod(F.xxhash64("customer_id"), F.col("chunks") - 1) + 1
    body = (candidates.join(sizes, "approval_id")
            .groupBy("approval_id", place.cast("int").alias("chunk"), "chunks")
            .agg(F.sort_array(F.collect_list(F.struct("customer_id", "segment", "predicted_clv", "discount", "offer"))).alias("c"))
            .select("approval_id", "chunk", "chunks", F.to_json("c").alias("document")))
    return head.unionByName(body)


def draft_heads(documents: DataFrame) -> DataFrame:
    """approval_id, headline, message, selling_points, count of chunked drafts."""
    d = F.from_json("document", _DRAFT_HEAD).alias("d")
    return documents.filter("chunk = 0").select("approval_id", d).select("approval_id", "d.*")


def draft_candidates(documents: DataFrame) -> DataFrame:
    """approval_id and the candidates of chunked drafts, a row each."""
    c = F.from_json("document", f"array<struct<{_DRAFT_CANDIDATE.replace(' ', ':').replace(',:', ',')}>>")
    return documents.filter("chunk > 0").select("approval_id", F.inline(c))


def campaign_build(candidates: DataFrame, thread_id: str, created_at: str = "1970-01-01 00:00:00",
                   excluded: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One pending draft row: brief (JSON) + candidate count, after the
    reviewer's edits if there are any (``campaign_revision``).  The candidates
    themselves are a table keyed by (approval_id, customer_id), or chunks of a
    document (``draft_document``)."""
    if excluded is not None and overrides is not None:
        candidates = campaign_revision(candidates, excluded, overrides)
    elif excluded is not None or overrides is not None:
        raise ValueError("a revision has both excluded and overrides (either may be empty)")
    brief = campaign_brief(campaign_summary(candidates))
    return brief.select(
        F.lit(thread_id).alias("thread_id"),
        F.to_json(F.struct("headline", "message", "selling_points")).alias("brief"),
        F.lit("pending").alias("status"),
        F.col("count").alias("candidate_count"),
        F.to_timestamp_ntz(F.lit(created_at)).alias("created_at"))


def draft_with_candidates(draft: DataFrame, candidates: DataFrame) -> DataFrame:
    """``draft`` (one row, ``campaign_build``) with its candidates, offers and
    all, a row each, so that no draft stands whole in one value; the draft alone
    if it has none."""
    return F.broadcast(draft).join(candidates, F.lit(True), "left")


def campaign_drafts(candidates: DataFrame) -> DataFrame:
    """Pending approvals, one for each approval_id of ``candidates``
    (approval_id, thread_id, created_at, customer_id, segment, predicted_clv,
    discount, offer)."""
    heads = candidates.groupBy("approval_id").agg(F.min("thread_id").alias("thread_id"),
                                                  F.min("created_at").alias("created_at"))
    none = F.lit(None).cast("string")
    return heads.join(grouped_briefs(candidates), "approval_id").select(
        "approval_id", "thread_id", "brief", "candidate_count", F.lit("pending").alias("status"),
        none.alias("reviewer"), none.alias("review_note"),
        F.lit(None).cast("timestamp_ntz").alias("decided_at"), "created_at")


def campaign_decisions(approvals: DataFrame, candidates: DataFrame,
                       decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold the append-only decision log onto pending approvals: (approvals,
    candidates) afterwards.

    ``decisions``: approval_id, action ('revised', 'approved', 'rejected'),
    reviewer, review_note, decided_at, excluded (array of customer ids),
    overrides (map customer id → discount).  The first terminal decision
    (ties: by action, then reviewer) ends an approval and later ones are
    ignored.  Revisions up to that moment take effect: their excluded
    customers go, the latest override of a customer wins (ties: the smaller
    discount), and brief and count are made anew from what is left.  Rows that
    are not pending stay as they are, candidates included.  A revised row
    without a terminal decision stays pending, with the latest note."""
    pending = approvals.filter(F.col("status") == "pending").select("approval_id")
    log = decisions.join(pending, "approval_id", "left_semi")
    end = log.filter(F.col("action").isin("approved", "rejected")).groupBy("approval_id").agg(
        F.min(F.struct("decided_at", "action", "reviewer", "review_note")).alias("end"))
    revised = (log.filter(F.col("action") == "revised").join(end, "approval_id", "left")
               .filter(F.col("end").isNull() | (F.col("decided_at") <= F.col("end.decided_at"))))
    gone = revised.select("approval_id", F.explode("excluded").alias("customer_id")).distinct()
    changed = (revised.select("approval_id", "decided_at", F.explode("overrides").alias("customer_id", "_new"))
               .groupBy("approval_id", "customer_id")
               .agg(F.max(F.struct("decided_at", (-F.col("_new")).alias("neg"))).alias("_o"))
               .select("approval_id", "customer_id", (-F.col("_o.neg")).alias("_new")))
    left = (candidates.join(gone, ["approval_id", "customer_id"], "left_anti")
            .join(changed, ["approval_id", "customer_id"], "left")
            .withColumn("discount", F.coalesce("_new", "discount")).drop("_new").select(*candidates.columns))
    notes = revised.groupBy("approval_id").agg(F.max(F.struct("decided_at", "review_note")).alias("note"))
    briefs = grouped_briefs(left).select("approval_id", F.col("candidate_count").alias("_count"), F.col("brief").alias("_brief"))
    j = (approvals.join(end, "approval_id", "left").join(notes, "approval_id", "left")
         .join(briefs, "approval_id", "left"))
    final, edited = F.col("end").isNotNull(), F.col("note").isNotNull()
    empty = campaign_brief(approvals.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("avg_predicted_clv"), F.lit(0.0).alias("avg_discount")))
    empty = empty.select(F.to_json(F.struct("headline", "message", "selling_points")).alias("b")).scalar()
    after = j.select(
        "approval_id", "thread_id",
        F.when(edited, F.coalesce("_brief", empty)).otherwise(F.col("brief")).alias("brief"),
        F.when(edited, F.coalesce("_count", F.lit(0))).otherwise(F.col("candidate_count")).alias("candidate_count"),
        F.when(final, F.col("end.action")).otherwise(F.col("status")).alias("status"),
        F.when(final, F.col("end.reviewer")).otherwise(F.col("reviewer")).alias("reviewer"),
        F.when(final, F.col("end.review_note")).when(edited, F.col("note.review_note"))
         .otherwise(F.col("review_note")).alias("review_note"),
        F.when(final, F.col("end.decided_at")).otherwise(F.col("decided_at")).alias("decided_at"),
        "created_at")
    return after, left


def campaign_latest(approvals: DataFrame) -> DataFrame:
    """Each thread's newest approval (ties: the larger approval_id)."""
    newest = approvals.groupBy("thread_id").agg(F.max(F.struct("created_at", "approval_id")).alias("_n"))
    return approvals.join(newest.select(F.col("_n.approval_id").alias("approval_id")), "approval_id", "left_semi")


def campaign_list(approvals: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    a = approvals if status is None else approvals.filter(F.col("status") == status)
    d = F.from_json("brief", "struct<headline:string>")
    return (a.select("approval_id", "thread_id", "status", "created_at", d["headline"].alias("headline"),
                     "candidate_count")
            .orderBy(F.desc("created_at"), "thread_id", "approval_id").limit(limit))


# ------------------------------------------------------------ conversations
def conversation_history(messages: DataFrame) -> DataFrame:
    """thread_id, position (from 1), turn, role, content in order; non-human
    roles → ai.  Rows, not one array for a thread, however long it gets."""
    m = messages.withColumn("role", F.when(F.col("role") == "human", "human").otherwise("ai"))
    w = Window.partitionBy("thread_id").orderBy("turn", "role", "content")
    return m.select("thread_id", F.row_number().over(w).alias("position"), "turn", "role", "content")


def conversation_append(threads: DataFrame, history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) after ``new`` (thread_id, customer_id, turn, role,
    content) came in: messages are appended, unknown threads made, and a
    thread's customer is set by its first non-NULL one in ``new``."""
    first = new.groupBy("thread_id").agg(F.min(F.when(F.col("customer_id").isNotNull(),
                                                      F.struct("turn", "customer_id"))).alias("_f"))
    threads = thread_upsert(threads, first.select("thread_id", F.col("_f.customer_id").alias("customer_id")))
    return threads, history.unionByName(new.select(*history.columns))


def thread_upsert(threads: DataFrame, updates: DataFrame) -> DataFrame:
    """(thread_id, customer_id): customer id replaced only by a non-NULL value."""
    return (threads.join(updates.withColumnRenamed("customer_id", "_new"), "thread_id", "full")
            .select("thread_id", F.coalesce(F.col("_new"), F.col("customer_id")).alias("customer_id")))


def value_violations(rows: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """value → rows of those that are not allowed (NULL included)."""
    bad = rows.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def role_violations(messages: DataFrame) -> DataFrame:
    return value_violations(messages, "role", ROLES)


def status_violations(approvals: DataFrame) -> DataFrame:
    return value_violations(approvals, "status", STATUSES)


def thread_cascade_delete(messages: DataFrame, approvals: DataFrame | None,
                          deleted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    d = deleted.select("thread_id")
    msg = messages.join(d, "thread_id", "left_anti")
    app = approvals.join(d, "thread_id", "left_anti") if approvals is not None else None
    return msg, app

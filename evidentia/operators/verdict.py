"""The verdict plane: one CASE ladder per stage; unknown evidence is stale, never valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import framed, short
from .guards import first_mismatch, valid_kind

STRATEGY = "dynamic-state/1"
PROOF_STRATEGY = "observation/1"
SHARED_STATE = "shared dynamic state"
#: Who a purity is attributed to. A proof is bound to the first.
PURITY = ("caller assertion", "source directive", "caller assertion and source directive")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _verdict(status: str, reason) -> Column:
    return F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def reason_or(reason: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(reason, F.lit("")), F.lit(fallback))


def compartment_stale(recorded: Column, current: Column) -> Column:
    return (_text(recorded) == "") | (_text(recorded) != _text(current))


def evidence(rec_core: Column, cur_core: Column, rec_tests: Column, cur_tests: Column, rec_strategy: Column, strategy: str = STRATEGY) -> Column:
    """The stale verdict that recorded evidence alone gives, or null. The compartment of tests is asked before the strategy."""
    same = _text(rec_core) == _text(cur_core)
    return (
        F.when(_text(rec_core) == "", _verdict("stale", "closure"))
        .when(same & compartment_stale(rec_tests, cur_tests), _verdict("stale", "test variants"))
        .when(~same, _verdict("stale", "closure"))
        .when(_text(rec_strategy) != strategy, _verdict("stale", "dynamic-state strategy"))
    )


def known_guards(manifest: Column, digest: Column, rt_ok: Column, rt_digest: Column, recorded: Column, current: Column, kind: Column) -> Column:
    mismatch = first_mismatch(recorded, current, kind)
    held = F.coalesce(rt_ok, F.lit(False)) & (_text(digest) != "") & (_text(digest) == _text(rt_digest))
    return (
        F.when((_text(manifest) == "") & (_text(digest) != ""), _verdict("stale", "runtimeinputs"))
        .when((_text(manifest) != "") & ~held, _verdict("stale", "runtimeinputs"))
        .when(mismatch != "", _verdict("stale", mismatch))
    )


def after_guards(external: Column, pure: Column, manifest: Column, rt_unverifiable: Column, rt_reason: Column, unverifiable: Column, reason: Column, observed: Column) -> Column:
    """Flags that are null count against the record."""
    impure = ~F.coalesce(pure, F.lit(False))
    present = _text(manifest) != ""
    substitutes = F.coalesce(observed, F.lit(False)) & present & ~F.startswith(_text(reason), F.lit(SHARED_STATE))
    open_ = F.coalesce(unverifiable, F.lit(True))
    return (
        F.when(F.coalesce(external, F.lit(True)), _verdict("unverifiable", "external directive"))
        .when(impure & present & F.coalesce(rt_unverifiable, F.lit(True)), _verdict("unverifiable", reason_or(rt_reason, "runtime inputs")))
        .when(impure & open_ & ~substitutes, _verdict("unverifiable", reason_or(reason, "external dependence")))
        .otherwise(_verdict("valid", ""))
    )


def proof_evidence(closure: Column, assertion: Column, strategy: Column, package: Column, symbol: Column, observable: Column, reason: Column) -> Column:
    """Binds a proof to the closure and the assertion that it was made under. The flag stands between the frames, bare."""
    return short(F.concat(framed(closure, assertion, strategy, package, symbol), observable.cast("string"), framed(reason)))


def compatible_proof(proof: Column, assertion: Column, subject: Column, closure: Column) -> Column:
    """A proof of this subject under this closure, on a caller's assertion, by this strategy, observable exactly if it names
    no reason, with its own digest. A proof of another closure proves nothing of this one."""
    held = (assertion == PURITY[0]) & (_text(closure) != "")
    same = (proof["strategy"] == PROOF_STRATEGY) & (proof["subject"]["package"] == subject["package"]) & (proof["subject"]["symbol"] == subject["symbol"])
    told = (_text(proof["reason"]) == "") == proof["observable"]
    sealed = proof["evidence"] == proof_evidence(closure, assertion, proof["strategy"], subject["package"], subject["symbol"], proof["observable"], _text(proof["reason"]))
    return F.coalesce(held & same & told & sealed, F.lit(False))


def pure_applies(recorded: Column, current: Column) -> Column:
    """Both attributions are of the vocabulary; they need not be the same."""
    return F.coalesce(recorded.isin(*PURITY) & current.isin(*PURITY), F.lit(False))


def purity_assertion(by_caller: Column, by_directive: Column, external: Column, ambiguous: Column) -> Column:
    """Who calls a subject pure; an external or ambiguous one isn't."""
    held = F.coalesce(external, F.lit(True)) | (_text(ambiguous) != "")
    return F.when(held, "").when(by_caller & by_directive, PURITY[2]).when(by_caller, PURITY[0]).when(by_directive, PURITY[1]).otherwise("")


def observed_reason(external: Column, ambiguous: Column, downgrade: Column, open_world: Column, base: Column) -> Column:
    """Later observations override earlier ones, so the last is asked first."""
    return (
        F.when(F.coalesce(external, F.lit(False)), "external directive")
        .when(_text(ambiguous) != "", ambiguous)
        .when(_text(downgrade) != "", downgrade)
        .when(F.coalesce(open_world, F.lit(False)), "open subject world")
        .otherwise(_text(base))
    )


def check(recordings: DataFrame, current: DataFrame, runtime: DataFrame, observed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdicts, errors). current: a row a subject with closure, guards and purity; runtime: a row a distinct manifest.
    Rows that evidence decides never ask for runtime states. A recording of an impossible kind is an error, no verdict."""
    r = recordings.alias("r")
    c = current.select("subject", *[F.col(x).alias(f"c_{x}") for x in current.columns if x != "subject"])
    legal = valid_kind(F.col("result_kind"), F.col("guards"))
    errors = r.filter(~legal).select("subject", F.lit("recorded kind and guards disagree").alias("error"))
    rows = r.filter(legal).join(c, "subject", "left")
    rows = rows.withColumn("early", evidence(F.col("maximal_closure"), F.col("c_hash"), F.col("test_variant_closure"), F.col("c_test_variants"), F.col("dynamic_state_strategy")))
    states = runtime.select(F.col("manifest").alias("m"), F.col("ok").alias("rt_ok"), F.col("digest").alias("rt_digest"), F.col("unverifiable").alias("rt_unverifiable"), F.col("reason").alias("rt_reason"))
    rows = rows.join(states, F.col("early").isNull() & (F.nullif("runtime_inputs", F.lit("")) == F.col("m")), "left")
    # bound to what is there now: evidence has made sure that the recorded closure is the same
    seen = compatible_proof(F.col("proof"), F.col("observation_assertion"), F.col("subject"), F.col("c_hash")) & F.coalesce(F.col("proof.observable"), F.lit(False)) if observed else F.lit(False)
    late = F.coalesce(
        known_guards(F.col("runtime_inputs"), F.col("runtime_digest"), F.col("rt_ok"), F.col("rt_digest"), F.col("guards"), F.col("c_guards"), F.col("result_kind")),
        after_guards(F.col("c_external"), pure_applies(F.col("purity_assertion"), F.col("c_purity")), F.col("runtime_inputs"), F.col("rt_unverifiable"), F.col("rt_reason"), F.col("c_unverifiable"), F.col("c_reason"), seen),
    )
    return rows.select("subject", F.coalesce("early", late).alias("verdict")), errors


def distinct_manifests(recordings: DataFrame) -> DataFrame:
    """Each manifest is evaluated once a phase, whatever the number of records that carry it."""
    return recordings.select(F.col("runtime_inputs").alias("manifest")).filter(_text(F.col("manifest")) != "").distinct()


def demote_moved(verdicts: DataFrame, opening: DataFrame, closing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stale where a record's runtime state moved between the two observations. manifests: subject, manifest."""
    o, c = opening.select("manifest", F.col("digest").alias("d0")), closing.select("manifest", F.col("digest").alias("d1"))
    moved = o.join(c, "manifest", "full").filter(~F.col("d0").eqNullSafe(F.col("d1"))).select("manifest")
    hit = manifests.join(moved, "manifest", "left_semi").select("subject", F.lit(True).alias("moved"))
    rows = verdicts.join(hit, "subject", "left")
    return rows.select("subject", F.when(F.col("moved"), _verdict("stale", "runtimeinputs")).otherwise(F.col("verdict")).alias("verdict"))


def first_three(values: DataFrame, key: str, value: str) -> DataFrame:
    """key -> its three least values and how many more there are, as text. Groups are reduced to ranks before text is made."""
    ranked = values.select(key, value).distinct().withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(value)))
    sizes = ranked.groupBy(key).agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.col(value)))).alias("first"))
    text = F.array_join("first", ", ")
    return sizes.select(key, F.when(F.col("size") > 3, F.concat(text, F.lit(", and "), (F.col("size") - 3).cast("string"), F.lit(" more"))).otherwise(text).alias("summary"))

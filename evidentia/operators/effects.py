"""External effects: classification by rule tables, preferred causes, and the ladder that proves a subject observable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

ORDER = ["kind", "package_path", "symbol", "detail", "reason", "unrefinable", "observable"]


def total_order() -> Column:
    plain = lambda c, none: F.coalesce(c, F.lit(none)).alias(c)
    return F.struct(plain("kind", 0), plain("package_path", ""), plain("symbol", ""), plain("detail", ""), plain("reason", ""), plain("unrefinable", False), plain("observable", False))


def classify(calls: DataFrame) -> DataFrame:
    """calls (fn, pkg, symbol, std, writer_in_memory; receiver: of a method, its type's name, if given) -> effects. Rules first;
    a writer-first print into memory is none; a subtest driver (Run of T or B) and harness logging are admitted, observable;
    audited symbols and packages are none; what else the standard library holds is unaudited; third-party calls are walked
    instead."""
    spark = calls.sparkSession
    found = calls.join(F.broadcast(rules.effect_rules(spark)), ["pkg", "symbol"], "left").join(F.broadcast(rules.pure_rules(spark).withColumn("pure", F.lit(True))), ["pkg", "symbol"], "left")
    in_memory = (F.col("pkg") == "fmt") & F.startswith("symbol", F.lit("Fprint")) & F.coalesce("writer_in_memory", F.lit(False))
    logging = (F.col("pkg") == "testing") & F.col("symbol").isin(*rules.HARNESS_LOGGING)
    receiver = F.col("receiver") if "receiver" in calls.columns else F.lit(None).cast("string")
    driver = F.coalesce((F.col("pkg") == "testing") & (F.col("symbol") == "Run") & receiver.isin("T", "B"), F.lit(False))
    unaudited = F.coalesce("std", F.lit(True)) & ~F.coalesce("pure", F.lit(False)) & ~rules.fallback_exempt(F.col("pkg"))
    kind = F.when(in_memory, None).when(F.col("kind").isNotNull(), F.col("kind")).when(logging, rules.KIND["test_runtime"]).when(unaudited, rules.KIND["unaudited_standard"])
    logged = F.concat(F.lit("reaches testing."), "symbol", F.lit(" (test harness logging)"))
    other = F.concat(F.lit("reaches unaudited standard operation "), "pkg", F.lit("."), "symbol")
    reason = F.when(driver, "reaches testing.Run (test harness subtest execution)").otherwise(F.coalesce("reason", F.when(logging, logged).otherwise(other)))
    rows = found.select("fn", kind.alias("kind"), F.col("pkg").alias("package_path"), "symbol", F.lit("").alias("detail"), reason.alias("reason"), F.lit(False).alias("unrefinable"), (driver | F.coalesce(logging, F.lit(False))).alias("observable"))
    return rows.filter("kind is not null").distinct()


def distinct_effects(effects: DataFrame) -> DataFrame:
    return effects.filter(F.coalesce("reason", F.lit("")) != "").dropDuplicates()


def ranked(effects: DataFrame) -> DataFrame:
    return effects.withColumn("rank", rules.cause_rank(F.col("kind"), F.col("package_path"), F.col("observable")))


def preferred_reason(effects: DataFrame, key: str) -> DataFrame:
    """key -> the reason of highest rank, the least of equals."""
    return ranked(distinct_effects(effects)).groupBy(key).agg(F.min_by("reason", F.struct(-F.col("rank"), F.col("reason"))).alias("reason"))


def package_reason(effects: DataFrame, fallbacks: DataFrame, key: str = "pkg") -> DataFrame:
    """Effects name the reason; imports (fallbacks) only where no effect does."""
    own = preferred_reason(effects, key)
    spare = ranked(distinct_effects(fallbacks)).groupBy(key).agg(F.min_by("reason", F.struct(-F.col("rank"), F.col("reason"))).alias("spare"))
    return own.join(spare, key, "full").select(key, F.coalesce("reason", "spare").alias("reason"))


def first_blocking(effects: DataFrame, key: str) -> DataFrame:
    """key -> reason of the first, in total order, of the highest-ranked effects that are not observable."""
    rows = ranked(distinct_effects(effects)).filter(~F.coalesce("observable", F.lit(False)))
    return rows.groupBy(key).agg(F.min_by("reason", F.struct((-F.col("rank")).alias("r"), total_order().alias("o"))).alias("reason"))


def scan_blockers(effects: DataFrame) -> DataFrame:
    """Package-scan effects that block: all but those exempt."""
    exempt = rules.scan_exempt(effects.sparkSession).select(F.col("pkg").alias("package_path"), "symbol")
    harness = F.coalesce("property_harness", F.lit(False)) if "property_harness" in effects.columns else F.lit(False)
    return effects.filter((F.col("reason") != rules.RECEIVER_ESCAPE) & ~harness).join(F.broadcast(exempt), ["package_path", "symbol"], "left_anti")


def attributed(reached: DataFrame, effects: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(subject, effect columns): effects of the functions that a subject reaches; functions (fn, std) leaves out standard ones."""
    rows = effects if functions is None else effects.join(functions.filter(~F.coalesce("std", F.lit(False))).select("fn"), "fn", "left_semi")
    return reached.join(rows, "fn")


def tally(reached: DataFrame, effects: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(subject, n, worst): how many effects a subject's functions have, and the highest rank of them. Counted once a function,
    so that a subject meets a row a function and not a row an effect."""
    each = ranked(effects).groupBy("fn").agg(F.count("*").alias("each"), F.max("rank").alias("worst"))
    return attributed(reached, each, functions).groupBy("subject").agg(F.sum("each").alias("n"), F.max("worst").alias("worst"))


def observability(subjects: DataFrame, startup: DataFrame, test_main: DataFrame, subject_effects: DataFrame, widens: DataFrame, package_scan: DataFrame, poisoned: DataFrame) -> DataFrame:
    """subjects (subject, package, open_world) -> subject, observable, reason. The first rung that refuses names the reason:
    startup effects, startup dispatch, test-main dispatch, test-main effects, subject dispatch, package scan, registrations
    that can't be traced, subject effects. widens: subject, tier (startup, testmain, own), reason."""
    def tier(df: DataFrame, name: str) -> DataFrame:
        return df.select("subject", F.col("reason").alias(name))

    wide = widens.groupBy("subject").agg(*[F.min(F.when(F.col("tier") == t, F.coalesce("reason", F.lit("")))).alias(f"w_{t}") for t in ("startup", "testmain", "own")])
    scan = scan_blockers(package_scan).groupBy("package").agg(F.min_by("reason", total_order()).alias("scan"))
    poison = poisoned.groupBy("package").agg(F.min_by("reason", "path").alias("poison"))
    rows = subjects.join(tier(preferred_reason(startup, "subject"), "startup"), "subject", "left").join(tier(first_blocking(test_main, "subject"), "main"), "subject", "left")
    rows = rows.join(tier(first_blocking(subject_effects, "subject"), "own"), "subject", "left").join(wide, "subject", "left").join(scan, "package", "left").join(poison, "package", "left")
    said = lambda c, fallback: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(fallback))
    closed = "subject reachability is not closed: "
    reason = (
        F.when(F.col("startup").isNotNull(), F.concat(F.lit("startup effect: "), "startup"))
        .when(F.col("w_startup").isNotNull(), F.concat(F.lit("startup effect: "), said("w_startup", "startup dispatch is not closed")))
        .when(F.col("w_testmain").isNotNull(), said("w_testmain", "test-main dispatch is not closed"))
        .when(F.col("main").isNotNull(), F.col("main"))
        .when(F.col("w_own").isNotNull() | F.coalesce("open_world", F.lit(True)), F.concat(F.lit(closed), said("w_own", "open subject world")))
        .when(F.col("scan").isNotNull(), F.concat(F.lit("package scan: "), "scan"))
        .when(F.col("poison").isNotNull(), F.col("poison"))
        .otherwise(F.coalesce("own", F.lit("")))
    )
    return rows.select("subject", (reason == "").alias("observable"), reason.alias("reason"))

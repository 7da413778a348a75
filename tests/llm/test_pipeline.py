import re

import pytest

import corpus_pipeline as p
from evidentia.llm import byte_gru, mixing, piece_dropout, simhash_segments
from evidentia.llm.common import materialise


@pytest.fixture(scope="module")
def results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name))
    return out


def test_stages_keep_the_columns_and_only_take_away(results):
    for before, after in zip(results[:-2], results[1:-1]):
        assert before.columns == after.columns
        assert after.exceptAll(before).isEmpty()
    assert results[-1].count() == results[-2].count()


def test_clean_documents_stay(results, spark, sf):
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in results[2].collect()}
    assert len(good & kept) >= 0.97 * len(good & {r.doc_id for r in results[0].collect()})


def test_one_of_each_group_stays(results):
    before = sorted((r.doc_id, simhash_segments.fingerprint(r.text)) for r in results[2].collect())
    label = list(range(len(before)))
    changed = True
    while changed:
        changed = False
        for i in range(len(before)):
            for j in range(i):
                if bin(before[i][1] ^ before[j][1]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert {r.doc_id for r in results[3].collect()} == {before[k][0] for k in set(label)}


def brute_mix(rows: list[dict], share: float, seed: int = 6) -> set[int]:
    """Ids that the mix takes, by plain recursion over the tree. rows: id, domain, lang, source, n."""
    from hashlib import md5

    weights, levels = mixing.WEIGHTS, mixing.LEVELS

    def spread(members: list[dict], depth: int, budget: int) -> set[int]:
        if depth == len(levels):
            once = sum(r["n"] for r in members)
            if once <= budget:
                return {r["id"] for r in members}
            taken, used = set(), 0
            for r in sorted(members, key=lambda r: md5(f"{seed}:0:{r['id']}".encode()).hexdigest()):
                used += r["n"]
                if used > budget:
                    break
                taken.add(r["id"])
            return taken
        level = levels[depth]
        groups: dict[str, list[dict]] = {}
        for r in members:
            groups.setdefault(r[level], []).append(r)
        nodes = sorted((sum(r["n"] for r in g) / weights.get(level, {}).get(k, 1), k) for k, g in groups.items())
        left, weight = budget, sum(weights.get(level, {}).get(k, 1) for k in groups)
        shares, open_, water = {}, [], 0.0
        for ratio, k in nodes:
            w, cap, here = weights.get(level, {}).get(k, 1), sum(r["n"] for r in groups[k]), left / weight
            if ratio <= here:
                shares[k] = cap
            else:
                open_.append(k)
                water = max(water, here)
            left, weight = left - cap, weight - w
        shares |= {k: int(weights.get(level, {}).get(k, 1) * water) for k in open_}
        return set().union(*[spread(g, depth + 1, shares[k]) for k, g in groups.items()])

    total = sum(r["n"] for r in rows)
    return spread(rows, 0, int(total * share))


def test_the_mix_against_plain_recursion(results):
    rows = []
    for r in results[3].collect():
        source = r.source if r.source is not None else "none"
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        rows.append({"id": r.doc_id, "domain": f"d{len(source) % 3}", "lang": r.lang if r.lang is not None else "none", "source": source, "n": n})
    taken = brute_mix(rows, p.MIX_SHARE[0] / p.MIX_SHARE[1])
    assert 0 < len(taken) < len(rows) and {r.doc_id for r in results[4].collect()} == taken


def test_pieces_decode(results):
    c = piece_dropout.coder(piece_dropout.model_path(), 0.0)
    texts = {r.doc_id: r.text for r in results[-2].collect()}
    assert all(r.lossless and c.decode(r.ids) == texts[r.doc_id] for r in results[-1].limit(30).collect())


def test_empty_and_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (10**9, "", "en", "s", 0, 2), (10**9 + 1, "word " * 60_000, None, "s", 5, 3)], schema)
    # without labels all pass the first stage; without a text to learn a language from none passes the second
    for docs, expected in ((odd, [3, 0, 0, 0, 0]), (odd.limit(0), [0] * 5)):
        counts = []
        for name, stage in p.STAGES:
            docs = materialise(stage(spark, docs, sf), name)
            counts.append(docs.count())
        assert counts == expected


def test_run(spark, sf, results):
    assert p.run(spark, sf).count() == results[-1].count()
    assert [s for s, _ in p.STAGES] == ["quality", "language", "near_duplicates", "mix", "pieces"] and p.ORACLE_SQL is None
    assert byte_gru.held_out is not None


def test_the_language_threshold_goes_with_the_number_of_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang in ('en', 'de')")
    noise = spark.createDataFrame([(10**9 + i, "zqx " + "".join(chr(0x4E00 + (i * 37 + j) % 900) for j in range(400)), None, "s", 5) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.language(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(noise), sf)
    clean = docs.filter("lang is not null").count()
    assert kept.filter("doc_id < 1000000000").count() >= 0.95 * clean

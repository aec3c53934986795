"""Large evaluation documents: any cut into ranges gives the records of the plain parser, and memory does not follow the size."""

import json
import random

import pytest

from rollspark.sources import evaldoc as E

FIELDS = {"problem_id", "ground_truth", "n_correct", "rewards", "preds", "rollouts"}


def document(n, seed=0, indent=2):
    rng = random.Random(seed)
    odd = ['"problem_id": ', '\\"problem_id\\": 3', "}]{[", '", "per_prompt": [', "tail\\", "é漢\U0001f642", "line\nline", "", "x" * 3000]
    sets = {}
    for name, k in (("aime", n), ("none", 0), ('o"dd', n // 2), ("last", 1)):
        per = []
        for i in range(k):
            r = {"problem_id": f"{name}-{i}", "rendered_prompt": rng.choice(odd), "ground_truth": rng.choice(odd), "n_correct": i, "rewards": [1.0, 0.0], "preds": [rng.choice(odd), None], "rollouts": [rng.choice(odd), rng.choice(odd)]}
            if i % 3 == 0:
                r["logprobs"] = [[{"5": -0.25, "7": -1e-9}] * 3]
            if i % 4 == 0:  # the key need not come first
                r = {**{c: r[c] for c in r if c != "problem_id"}, "problem_id": r["problem_id"]}
            per.append(r)
        sets[name] = {"n_prompts": k, "pass_at_k": {"1": 0.5, "pass@8": 1}, "mean_reward_at_1": 0.25, "per_prompt": per, "notes": {"after": [1, {"a": "]}"}]}}
    return {"label": "arm", "ckpt_path": None, "n_rollouts": 2, "datasets": sets, "more": [1, 2]}


@pytest.mark.parametrize("indent", [None, 2])
def test_any_cut_gives_the_same_records(tmp_path, indent):
    doc = document(24, 1, indent)
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    size = path.stat().st_size
    want = [{k: v for k, v in r.items() if k in FIELDS} for d in doc["datasets"].values() for r in d["per_prompt"]]
    names = [n for n, d in doc["datasets"].items() for _ in d["per_prompt"]]
    for step in (97, 500, 4001, size):
        cuts = list(range(0, size, step))
        sections = [s for lo in cuts for _, s in E.sections_in(str(path), lo, min(lo + step, size))]
        assert [(s.dataset, s.head["n_prompts"]) for s in sections] == [("aime", 24), ("none", 0), ('o"dd', 12), ("last", 1)]
        got = [x for lo in cuts for x in E.records_in(str(path), lo, min(lo + step, size), FIELDS, 64)]
        assert [r for _, r in got] == want
        assert [[s.dataset for s in sections if s.at < at][-1] for at, _ in got] == names


def test_read_by_spark(spark, tmp_path):
    docs = [document(n, n) for n in (5, 30)]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "9.json").write_text('{"label": "none", "datasets": {}}')
    df = E.read_eval_document(spark, f"{tmp_path}/*.json", range_bytes=2000)
    assert df.rdd.getNumPartitions() > 10
    got = sorted((r.dataset, r.problem_id, r.ground_truth, r.n_correct, tuple(r.rewards), tuple(r.preds), tuple(r.rollouts)) for r in df.collect())
    want = sorted((n, r["problem_id"], r["ground_truth"], r["n_correct"], tuple(r["rewards"]), tuple(r["preds"]), tuple(r["rollouts"])) for doc in docs for n, d in doc["datasets"].items() for r in d["per_prompt"])
    assert str(got) == str(want)
    assert E.flatten_records(df).count() == 2 * len(want)
    heads = E.read_eval_headers(spark, f"{tmp_path}/*.json", range_bytes=1000).collect()
    assert len(heads) == 8 and all(h.label == "arm" and h.pass_at_k == {"1": 0.5, "pass@8": 1.0} for h in heads)
    assert [h.dataset for h in E.read_eval_headers(spark, f"{tmp_path}/*.json", all_datasets=False).collect()] == ["aime", "aime"]
    assert E.read_eval_document(spark, f"{tmp_path}/9.json").count() == 0 == E.read_eval_headers(spark, f"{tmp_path}/no.json").count()


def test_memory_follows_records_not_documents(tmp_path):
    path = tmp_path / "large.json"
    heavy = json.dumps([[{str(t): -0.5 for t in range(20)}] * 2000])
    with path.open("w") as f:
        f.write('{"label": "a", "datasets": {"d": {"n_prompts": 40, "per_prompt": [')
        for i in range(40):
            f.write(("," if i else "") + f'{{"problem_id": "{i}", "logprobs": {heavy}, "rewards": [1.0]}}')
        f.write("]}}}")
    size, seen = path.stat().st_size, []
    assert size > 15 << 20
    got = [r["problem_id"] for lo in range(0, size, 1 << 20) for _, r in E.records_in(str(path), lo, min(lo + (1 << 20), size), {"problem_id", "rewards"}, 1 << 14, seen)]
    assert got == [str(i) for i in range(40)]
    assert max(seen) < 1 << 17
    read = []
    real = E.opened

    def counted(p):
        stream, n = real(p)

        class Stream:
            seek = stream.seek

            def read(self, k):
                read.append(k)
                return stream.read(k)

        return Stream(), n

    E.opened = counted
    try:
        assert len(list(E.sections_in(str(path), 0, 1, first_only=True))) == 1
    finally:
        E.opened = real
    assert sum(read) < 1 << 18


def test_what_is_no_document_fails(tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"datasets": {"d": {"per_prompt": [{"problem_id": "1", "x": {"problem_id": 2}}, 7]}}}')
    with pytest.raises(ValueError):
        list(E.records_in(str(path), 0, 10_000, {"problem_id"}))


def test_small_ranges_share_tasks(spark):
    few = [E.Range("a", lo, lo + 10) for lo in range(0, 1000, 10)]
    assert [t.parts for t in E.dealt(few)] == [[r] for r in few] and E.dealt([]) == []
    many = [E.Range(f"f{i % 7}", 0, 1 + i % 50) for i in range(50_000)]
    tasks = E.dealt(many)
    assert [r for t in tasks for r in t.parts] == many and len(tasks) <= E.TASKS
    large = [E.Range("b", lo << 20, (lo + 128) << 20) for lo in range(0, 128 * 1000, 128)]
    assert len(E.dealt(large)) == 1000


def test_tasks_do_not_carry_the_list_of_files(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.json").write_text('{"label": "x", "datasets": {"d": {"n_prompts": 1, "per_prompt": [{"problem_id": "p%d", "n_correct": 1}]}}}' % i)
    df = E.read_eval_document(spark, f"{tmp_path}/*.json", ("problem_id",), range_bytes=16)
    assert sorted(r.problem_id for r in df.collect()) == sorted(f"p{i}" for i in range(30))
    assert "29.json" not in df._jdf.queryExecution().analyzed().toString() and df.rdd.getNumPartitions() <= E.TASKS

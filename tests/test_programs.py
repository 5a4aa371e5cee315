import pytest

from sparkloom.plans import program as prog


def fresh():
    c = prog.Catalog()
    c.write("px.n", 3)
    c.register("fn.double", lambda x: 2 * x)
    c.register("fn.both", lambda x: (x, -x))
    return c


def test_run_publishes_after_a_tick():
    c = fresh()
    p = prog.Program().calc("a", "fn.double", id="d", into="px.d", x="px.n").calc("b", "fn.both", id="s", into=["px.p", "px.m"], x="px.d")
    record = p.run(c)
    assert (c.read("px.p"), c.read("px.m")) == (6, -6)
    assert [r.id for r in record.receipts] == ["d", "s"]
    assert prog.Query.prefix("px.receipt.").where(lambda r: r.id == "s").one(c).writes == ["px.p", "px.m"]
    assert prog.Program.from_json(p.to_json()).to_json() == p.to_json()
    assert "d --> s" in p.to_mermaid()


def test_laws_of_a_program():
    c = fresh()
    with pytest.raises(ValueError, match="two writers"):
        prog.Program().calc("a", "fn.double", id="x", into="px.d", x="px.n").calc("a", "fn.double", id="y", into="px.d", x="px.n")
    with pytest.raises(ValueError, match="later"):
        prog.Program().calc("a", "fn.double", id="x", into="px.d", x="px.e").calc("b", "fn.double", id="y", into="px.e", x="px.n").run(c)
    with pytest.raises(ValueError, match="another body"):
        c.register("fn.double", lambda x: 3 * x)
    with pytest.raises(KeyError):
        c.read("px.none")
    p = prog.Program().calc("a", "fn.double", id="x", into="px.d", x="px.n")
    assert p.run(c, budget_ms=-1).ticks == []


def test_flowcharts():
    p = prog.compile_mermaid("flowchart LR\n a[fn.one] --> b[fn.two]\n a --> c[fn.three]")
    assert list(p.ticks) == ["t0", "t1"] and p.classify("t1") == "parallel"
    with pytest.raises(ValueError, match="cycle"):
        prog.compile_mermaid("flowchart LR\n a[x] --> b[y]\n b --> a")


def test_effects_replay():
    e = prog.Effects(5)
    drawn = e.draws(3)
    assert prog.Replay(e.ledger).draws(3) == drawn
    with pytest.raises(RuntimeError):
        prog.Replay(e.ledger).clock()


def test_memo_reads_back(spark, tmp_path):
    memo = prog.Memo(spark, str(tmp_path))
    for _ in range(2):
        assert memo.get("range", {"n": 4}, lambda: spark.range(4)).count() == 4
    assert prog.Memo(spark, str(tmp_path)).get("range", {"n": 4}, lambda: 1 / 0).count() == 4
    assert memo.counters == {"requests": 2, "hits": 1, "disk": 0, "misses": 1}


def test_study_finds_what_was_planted(spark):
    from sparkloom.plans import study

    rows = [(float(i % 50), 2.0 * (i % 50) + (i * 7 % 5), "ab"[i % 2], 1.0, (50.0 if i % 2 else 0.0) + i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, g string, flat double, z double")
    p = study.plan(df, "y")
    assert (p.group, p.constants, p.task) == ("g", ["flat"], "regress")
    assert [(r.a, r.b) for r in study.pairs(df, ["x", "y"]).collect()] == [("x", "y")]
    assert study.compare_groups(df, "g", "z")["p"] < 1e-6
    assert study.models(df.select("x", "y"), study.plan(df.select("x", "y"), "y"), [])[0]["name"] != "baseline"


def test_study_scores_all_rows_and_names_directions(spark):
    from sparkloom.plans import study

    df = spark.range(3000).selectExpr("double(id % 50) as x", "double(id % 50) * 2 + id % 3 as w", "double((id * 37) % 11) as z", "if(id = 2999, 1e6, double(id % 7)) as t")
    base = next(m for m in study.models(df, study.plan(df, "t"), []) if m["name"] == "baseline")
    assert base["score"] == pytest.approx(1e12 / 3000, rel=0.02)  # one far row in all 3,000
    d = study.directions(df, ["x", "w", "z"])
    assert d["ratio"][0] == pytest.approx(2 / 3, abs=0.02) and {c for c, v in zip(d["columns"], d["components"][0]) if abs(v) > 0.5} == {"x", "w"}
    said = [(r.kind, r.sentence) for r in study.study(df.select("x", "w", "z"), "w").collect()]
    assert len([k for k, _ in said if k == "directions"]) == 3

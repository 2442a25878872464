import datetime

import pytest

from loglantern.operators import retention as ret


def usage(spark, rows, newest="2019-01-01"):
    at = datetime.datetime.fromisoformat(newest)
    return spark.createDataFrame([("r", m, b, n or at) for m, b, n in rows], "root string, month string, bytes bigint, newest timestamp")


def test_retention_plan(spark):
    rows = usage(spark, [("2020-01", 1, None), ("2020-02", 1, None), ("2020-03", 1, None), ("2019-01", 1, None)])
    plan = {r["month"]: r["action"] for r in ret.retention_plan(rows, "2020-04-01", 1, 3).collect()}
    # 91, 60, 31 and 456 days old
    assert plan == {"2020-01": "delete", "2020-02": "compact", "2020-03": "compact", "2019-01": "delete"}
    plan = {r["month"]: r["action"] for r in ret.retention_plan(rows, "2020-03-31", 1, 0).collect()}
    assert plan["2020-03"] == "keep" and plan["2019-01"] == "compact"
    assert {r["action"] for r in ret.retention_plan(rows, "2020-04-01", 0, 0).collect()} == {"keep"}


def test_purge_plan(spark):
    recent = datetime.datetime(2020, 6, 14, 13)
    rows = usage(spark, [("2020-01", 100, None), ("2020-02", 200, recent), ("2020-03", 50, None), ("2020-04", 400, None), ("2020-06", 999, None)])

    def months(needed, keep=()):
        return sorted(r["month"] for r in ret.purge_plan(rows, needed, "2020-06-15 12:00:00", keep).collect())

    assert months(1) == ["2020-01"]
    assert months(100) == ["2020-01"]
    assert months(101) == ["2020-01", "2020-03"]
    assert months(151, ("2020-03",)) == ["2020-01", "2020-04"]
    assert months(550) == ["2020-01", "2020-03", "2020-04"]
    assert months(551) == []


def test_usage_compaction_and_deletion(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(200).selectExpr(
        "CASE WHEN id < 150 THEN '2020-01' ELSE '2020-02' END AS month", "'h' AS host", "id AS open_seq", "id AS seq", "'x' AS line")
    ret.write_captures(rows.repartition(5), root)
    ret.write_captures(rows.where("id < 3"), root)
    (tmp_path / "store" / "month=2020-13").mkdir()
    (tmp_path / "store" / "month=2020-13" / "x").write_text("no month")
    used = {r["month"]: r for r in ret.partition_usage(spark, root).collect()}
    assert set(used) == {"2020-01", "2020-02"} and used["2020-01"]["entries"] >= 2 and used["2020-01"]["bytes"] > 0
    assert ret.compact_month(spark, root, "2020-01") == 153
    again = {r["month"]: r for r in ret.partition_usage(spark, root).collect()}
    assert again["2020-01"]["entries"] == 1
    assert spark.read.parquet(f"{root}/month=2020-01").count() == 153
    ret.delete_months(spark, root, ["2020-01"])
    assert {r["month"] for r in ret.partition_usage(spark, root).collect()} == {"2020-02"}


def test_a_failed_compaction_leaves_every_month(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    rows = spark.range(40).selectExpr("CASE WHEN id < 20 THEN '2020-01' ELSE '2020-02' END AS month", "'h' AS host", "id AS open_seq", "id AS seq", "'x' AS line")
    ret.write_captures(rows.repartition(3), root)

    def counts():
        back = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/month=2020-01"), spark.read.parquet(f"{root}/month=2020-02")
        return [df.count() for df in back]

    moved, calls = ret._moved, []

    def second_fails(fs, source, target):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("no")
        moved(fs, source, target)

    monkeypatch.setattr(ret, "_moved", second_fails)
    with pytest.raises(RuntimeError):
        ret.compact_months(spark, root, ["2020-01", "2020-02"])
    assert counts() == [20, 20]  # the old month was put back
    monkeypatch.setattr(ret, "_moved", moved)
    # a job that died between the two renames: the month stands aside and comes back
    (tmp_path / "store" / "month=2020-01").rename(tmp_path / "store" / f"{ret.ASIDE}2020-01-dead")
    ret.recover_months(spark, root)
    assert counts() == [20, 20]
    assert ret.compact_months(spark, root, ["2020-01", "2020-02"]) == {"2020-01": 20, "2020-02": 20}
    assert counts() == [20, 20] and not [p for p in (tmp_path / "store").iterdir() if p.name.startswith((ret.FRESH, ret.ASIDE))]
    assert {r["month"]: r["compacted"] for r in ret.partition_usage(spark, root).collect()} == {"2020-01": True, "2020-02": True}
    assert ret.apply_plan(spark, root, spark.sql("SELECT '2020-02' AS month, 'delete' AS action")) == {"delete": ["2020-02"], "compact": []}
    assert {r["month"] for r in ret.partition_usage(spark, root).collect()} == {"2020-01"}


def test_settings(spark):
    with pytest.raises(ValueError):
        ret.retention_plan(usage(spark, [("2020-01", 1, None)]), "2020-04-01", -1, 0)

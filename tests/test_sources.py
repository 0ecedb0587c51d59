import pytest

from meterql.engine import Engine
from meterql.errors import QueryError
from meterql.sources import Catalog
from tests.fixtures import write_tables


def kinds(catalog, table):
    return [(f.name, f.type) for f in catalog.schema(table)]


def test_csv_types(spark, tmp_path):
    catalog = Catalog(spark, write_tables(tmp_path, odd=(
        "i,big,f,b,mixed,date,zero,plus,spaces,suffix\n1,99999999999999999999,1e3,TRUE,true,2024-01-01,0,+5, 7,1d\n-2,1,.5,False,1,2024-01-02,1,-5,8,2f\n"), headers="a,b\n", quotes='a,b\n"x, ""y""",\n"",2\n'))
    assert kinds(catalog, "staff") == [("id", "INT64"), ("name", "STRING"), ("salary", "FLOAT64"), ("active", "BOOL"), ("boss", "STRING")]
    assert [t for _, t in kinds(catalog, "odd")] == ["INT64", "FLOAT64", "FLOAT64", "BOOL", "STRING", "STRING", "INT64", "INT64", "INT64", "STRING"]
    assert kinds(catalog, "headers") == [("a", "STRING"), ("b", "STRING")] and catalog.frame("headers").count() == 0
    assert [tuple(r) for r in catalog.frame("quotes").collect()] == [('x, "y"', None), (None, 2)]


def test_ragged_rows_are_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        Catalog(spark, str(tmp_path)).frame("bad").collect()


def test_directory(spark, tmp_path):
    write_tables(tmp_path, dup="a\n1\n")
    spark.range(3).write.parquet(str(tmp_path / "dup.parquet"))
    spark.range(3).selectExpr("cast(id as int) as i", "cast(id as float) as f", "date'2024-01-01' as d", "array(id) as l").write.parquet(str(tmp_path / "wide.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "sub.csv").mkdir()
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.tables() == ["customers", "dup", "orders", "staff", "wide"]
    assert kinds(catalog, "dup") == [("a", "INT64")]
    assert kinds(catalog, "wide") == [("i", "INT64"), ("f", "FLOAT64"), ("d", "DATE"), ("l", "ARRAY<BIGINT>")]
    for name, message in (("", "empty"), ("../x", "invalid"), ("a/b", "invalid"), ("Orders", "not found"), ("notes", "not found")):
        with pytest.raises(QueryError, match=message):
            catalog.frame(name)
    with pytest.raises(QueryError, match="repeated fields"):
        Catalog(spark, str(tmp_path), strict_types=True).frame("wide")
    with pytest.raises(QueryError, match="not found"):
        Catalog(spark, str(tmp_path / "no")).tables()


def test_schemas_are_kept(spark, tmp_path):
    write_tables(tmp_path)
    engine = Engine(spark, str(tmp_path))
    engine.table_schema("staff")
    (tmp_path / "staff.csv").unlink()
    assert engine.table_schema("staff")[0].name == "id"

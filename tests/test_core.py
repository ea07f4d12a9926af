"""Hand-computed fixtures for kernels, traversals and sources."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from netloom import catalogue
from netloom.functions import geometry as G
from netloom.functions import similarity as S
from netloom.functions import text as Tx
from netloom.operators import graph as Gp
from netloom.operators import paths as P
from netloom.operators import routing, zone_design
from netloom.operators.components import components
from netloom.sources import designs, results, sinks

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("d, code", [((0, 0, 5), "R"), ((5, 0, 0), "H"), ((5, 0, 5), "D"), ((0, 0, 0), None)])
def test_segment_code(spark, d, code):
    assert one(spark, G.segment_code(*(F.lit(float(x)) for x in d))) == code


def test_box_hit_parallel_and_crossing(spark):
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, G.box_hit(p(-5, 0, 0), p(5, 0, 0), p(-1, -1, -1), p(1, 1, 1)))
    assert not one(spark, G.box_hit(p(-5, 2, 0), p(5, 2, 0), p(-1, -1, -1), p(1, 1, 1)))
    assert one(spark, G.box_hit(p(-5, 2, 0), p(5, 2, 0), p(-1, -1, -1), p(1, 1, 1), 1.0))


def test_pattern_similarity(spark):
    assert one(spark, S.pattern(F.lit("RHD"), F.lit("RHH"))) == pytest.approx(2 / 3)
    assert one(spark, S.pattern(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, S.pattern(F.lit(""), F.lit("R"))) == 0.0


def test_running_mean_is_not_gap_clustering(spark):
    values = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(i).alias("i")) for i, z in enumerate((0.0, 150.0, 350.0, 600.0))))
    got = one(spark, F.transform(P.running_mean_clusters(values, 200.0), lambda c: F.size(c)))
    assert got == [2, 1, 1]


def test_text(spark):
    assert one(spark, Tx.file_safe(F.lit("a b/c-d"))) == "a_b_c-d"
    assert one(spark, Tx.file_safe(F.lit(""))) == "Unknown"
    assert one(spark, Tx.multipoint_wkt(F.lit("(1, 2, 3) | (4, 5, 6)"))) == "MULTIPOINT Z ((1 2 3), (4 5 6))"
    assert one(spark, Tx.multipoint_wkt(F.lit("(0.50, 11, 2)"))) == "MULTIPOINT Z ((0.50 11 2))"
    assert one(spark, Tx.type_summary(F.array(F.lit("POC"), F.lit("ELBOW"), F.lit(None)))) == "PO->EB->??"
    assert one(spark, Tx.type_summary(F.array(*map(F.lit, ("valve", " duct", "Lateral", "LATERAL PIPE", "nozzle", "q"))))) == "VL->DT->LA->LP->NO->Q"
    assert one(spark, Tx.type_summary(F.array(F.lit("q")), pad=True)) == "Q?"
    assert one(spark, Tx.legend()["VL"]["type"]) == "VALVE" and one(spark, F.size(Tx.legend())) == 32
    assert one(spark, Tx.record_id(F.lit(""), F.lit("P1"))) == "P1" and one(spark, Tx.record_id(F.lit(None), F.lit(None))) == ""


def _p(x, y, z):
    return F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("xyz", (x, y, z))))


def test_serialised_vectors(spark):
    text = one(spark, Tx.vectors_text(F.array(_p(1, -2.5, 0), _p(12345678, 0, 3))))
    assert text == "(1.0,-2.5,0.0), (12345678.0,0.0,3.0)"
    assert [tuple(v) for v in one(spark, Tx.legacy_vectors(F.lit(text)))] == [(1.0, -2.5, 0.0), (12345678.0, 0.0, 3.0)]
    assert one(spark, Tx.vectors_text(F.array().cast("array<struct<x:double,y:double,z:double>>"))) == ""
    assert one(spark, Tx.lengths_text(F.array(F.lit(1.0), F.lit(20.25)))) == "1.0, 20.3"


@pytest.mark.parametrize("texts, wanted", [
    (("[1, 2.5, 3, 9]",), (1, 2.5, 3)), (("[1, 2]",), (0, 0, 0)), (('{"x": 1, "Y": 2}',), (1, 2, 0)),
    ((None, "[]", "[4,5,6]"), (4, 5, 6)), ((None,), (0, 0, 0)), (("{}", "null"), (0, 0, 0)),
])
def test_json_position(spark, texts, wanted):
    assert tuple(one(spark, Tx.json_position(*(F.lit(t).cast("string") for t in texts)))) == wanted


def test_projections(spark):
    assert tuple(one(spark, G.displacement(_p(1, 2, 3), _p(1.004, 4.126, 0)))) == (0.0, 2.13, -3.0)
    assert tuple(one(spark, G.y_up(_p(1, 2, 3)))) == (1.0, 3.0, -2.0)
    low, high = ({c: F.lit(v) for c, v in zip("xyz", p)} for p in ((0.0, 1.0, 2.0), (0.0, 3.0, 4.0)))
    assert one(spark, Tx.footprint_wkt(low, high)) == "POLYGON Z ((0.0 1.0 2.0, 0.01 1.0 2.0, 0.01 3.0 2.0, 0.0 3.0 2.0, 0.0 1.0 2.0))"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert components(edges.limit(0)).count() == 0


def test_simple_paths_in_a_cycle(spark):
    hops = Gp.undirected(spark.createDataFrame([("e1", "P", "A"), ("e2", "A", "B"), ("e3", "B", "C"), ("e4", "C", "A"), ("e5", "C", "D")], "edge string, a string, b string"))
    starts = spark.createDataFrame([("P",)], "start string")
    got = {">".join(r["nodes"]) for r in Gp.simple_paths(starts, hops, F.col("node") == "D").collect()}
    assert got == {"P>A>C>D", "P>A>B>C>D"}


def test_design_documents(spark, tmp_path):
    node = lambda g, t, c: {"guid": g, "type": t, "position": [0, 0, 0], "connectionGuidList": c}
    doc = {"Nodes": [node("p", "POC", ["e"]), node("t", "TAKEOFF", ["e"]), node("t", "takeoff", ["e"]), {"type": "X"}], "Edges": [{"guid": "e", "type": "PIPE", "connectionGuidList": ["p", "t"]}, {"guid": "v", "type": "VIRTUAL", "connectionGuidList": ["p", "t"]}], "Equipment": []}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "list.json").write_text("[1]")
    docs = designs.documents(spark, str(tmp_path))
    nodes, edges = designs.nodes(docs), designs.edges(docs)
    assert {(r["guid"], r["type"]) for r in nodes.collect()} == {("p", "POC"), ("t", "TAKEOFF")}
    assert {(r["src"], r["dst"]) for r in Gp.attached(nodes, edges).collect()} == {("p", "t"), ("t", "p")}


def test_import_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "f string, v int")
    new = spark.createDataFrame([("a", 3)], "f string, v int")
    once = sinks.replaced_files(old, new, "f")
    assert sorted(map(tuple, sinks.replaced_files(once, new, "f").collect())) == [("a", 3), ("b", 2)]


@pytest.mark.parametrize("name", ["path_features", "path_groups", "h_segments", "common_z_levels", "segment_hits", "branch_nodes", "routing_paths", "horizontal_bundles", "encode_vectors", "topk_filtered", "design_route", "latest_import"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "region", "nation", "supplier", "customer", "part", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalogue.ORACLE_SQL[name]).df()[list(got.columns)]
    key = lambda df: sorted(repr([round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in r]) for r in df.itertuples(index=False))
    assert key(got) == key(want)


def _documents(spark, tmp_path):
    node = lambda g, i, t, c, p, n="": {"guid": g, "id": i, "type": t, "name": n, "position": p, "connectionGuidList": c}
    edge = lambda g, a, b: {"guid": g, "type": "PIPE", "connectionGuidList": [a, b]}
    nodes = [
        node("p", "POC1", "POC", ["e1"], [0, 0, 0]), node("t", "T1", "TEE", ["e1", "e2", "e3"], [0, 0, 500]), node("d", "D1", "TAKEOFF", ["e2"], [800, 0, 500]),
        node("u", "U1", "EQUIPMENT", ["e3"], [0, 900, 500], "Dry_Pump_1"),
    ]
    poc = {"guid": "p", "id": "POC1", "name": "POC1", "utility": "PV", "utilityGroup": "Vaccum", "size": "40", "pocPosition": [0, 0, 0]}
    doc = {"Nodes": nodes, "Edges": [edge("e1", "p", "t"), edge("e2", "t", "d"), edge("e3", "t", "u")], "Equipment": [{"guid": "q", "id": "EQ1", "name": "Main", "pocList": [poc]}]}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    docs = designs.documents(spark, str(tmp_path))
    return docs, designs.nodes(docs), designs.edges(docs), designs.connections(docs)


def test_routing_of_documents(spark, tmp_path):
    docs, nodes, edges, points = _documents(spark, tmp_path)
    got = {r["kind"]: r for r in routing.routing_paths(nodes, edges, points).collect()}
    assert set(got) == {"DUCT", "EQUIPMENT"} and got["DUCT"]["arrow"] == "R-H" and got["EQUIPMENT"]["total_length"] == 1400.0
    report = routing.branch_report(nodes, edges, points).collect()
    assert [(r["branch"], r["type"], r["connections"], r["terminals"]) for r in report] == [("T1", "TEE", 3, ["D1", "POC1", "U1"])]
    assert routing.branch_summary(routing.branch_report(nodes, edges, points)).first()["types"] == {"TEE": 1}
    path = routing.vacuum_paths(nodes, edges, points).collect()
    assert [(r["direction_pattern"], r["total_length"], r["n_r"], r["n_h"]) for r in path] == [("R-H", 1400.0, 1, 1)]
    assert designs.bim_equipment(docs).first()["poc_total_count"] == 1


def test_caps_are_flagged(spark):
    hops = Gp.undirected(spark.createDataFrame([(f"e{k}", "P", f"A{k}") for k in range(5)], "edge string, a string, b string"))
    starts = spark.createDataFrame([("P",)], "start string")
    end = F.col("node").startswith("A")
    assert [r["cut"] for r in Gp.simple_paths(starts, hops, end).collect()] == [False] * 5
    assert [r["cut"] for r in Gp.simple_paths(starts, hops, end, per_start=2).collect()] == [True] * 2


def test_detour_round_a_column(spark):
    step = lambda x, y, z: (float(x), float(y), float(z), 0.0, "H")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4000.0, 0.0, 0.0, None, [step(4000, 0, 0)], [(0.0, 0.0, 0.0), (4000.0, 0.0, 0.0)])], "request_id long, sx double, sy double, sz double, tx double, ty double, tz double, trunk_z double, steps array<struct<dx:double,dy:double,dz:double,len:double,code:string>>, points array<struct<x:double,y:double,z:double>>")
    boxes = spark.createDataFrame([(7, "COLUMN_STRUCTURE", 1900.0, -100.0, -1000.0, 2100.0, 100.0, 1000.0)], "obstacle_id long, category string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = zone_design.zone_routes(rows, boxes).first()
    assert [tuple(s) for s in got["route"]] == [(0.0, 400.0, 0.0), (4000.0, 0.0, 0.0), (0.0, -400.0, 0.0)] and got["detours"] == 1


def test_stored_results(spark, tmp_path):
    doc = {"equipment_name": "E", "poc_paths": [{"start_poc_id": "P", "start_poc_info": {"utility": "U"}, "paths": [{"node_positions": [[0, 0, 0], [0, 0, 5], [3, 0, 5]]}, {"path_arrow": "H", "path_step_vector": "(1, 2, 2)", "path_step_length": "3"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    got = {r["path_no"]: r for r in results.routing_results(spark, str(tmp_path)).collect()}
    assert (got[0]["path_arrow"], got[0]["path_total_length"], got[0]["path_range"]["z"], got[0]["size"]) == ("R-H", 8.0, 5.0, "-")
    assert (got[1]["path_arrow"], got[1]["path_total_length"], got[1]["step_vectors"][0]["y"]) == ("H", 3.0, 2.0)
    segments = spark.createDataFrame([("s", "r", 1)], "segment_guid string, route_path_guid string, segment_order int")
    details = spark.createDataFrame([("s", 2), ("s", 1)], "segment_guid string, detail_order int")
    mapped = spark.createDataFrame([("m", "s", 1)], "route_path_guid string, segment_guid string, segment_order int")
    assert {r["route_path_guid"] for r in results.path_details(details, segments, mapped).collect()} == {"m"}
    assert [r["seq"] for r in results.path_details(details, segments, mapped.limit(0), "r").orderBy("detail_order").collect()] == [1, 2]


def test_spatial_terms(spark):
    p = lambda x: F.struct(*(F.lit(float(x)).alias(c) for c in "xyz"))
    path = lambda x, kind, far, names: F.struct(p(x).alias("start_rel"), p(x).alias("end_rel"), F.lit("E").alias("start_face"), F.lit(kind).alias("terminal_type"), F.lit(far).alias("terminal_distance"), F.lit("L").alias("terminal_level"), F.lit(names[0]).alias("start_level"), F.lit(names[-1]).alias("end_level"), F.array(*map(F.lit, names)).alias("levels"))
    a, b = path(0, "DUCT", 100.0, ["A", "B"]), path(0, "LATERAL", 0.0, ["A", "C"])
    assert one(spark, S.equip_relative(a, b)) == pytest.approx(1.0)
    assert one(spark, S.terminal(a, b)) == pytest.approx(0.4 * 0.3 + 0.3 * 0.3 + 0.3)
    assert one(spark, S.levels(a, b)) == pytest.approx(0.25 + 0 + 0.25 + 0.25 / 3)

"""Operators on literal rows."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.functions import json_text as J
from auditspark.functions import text as T
from auditspark.operators import candidates as C
from auditspark.operators import detectors as D
from auditspark.operators import events as E
from auditspark.operators import lookup as L
from auditspark.operators import metrics as M

FUNCTIONS = "function_id long, name string, signature string, file_path string, start_line int, end_line int, body string"


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_scope_stops_at_directories(spark):
    rows = spark.createDataFrame([("src/a.c", 1), ("src/nested/b.c", 10), ("src_extra/c.c", 20)], "file_path string, start_line int")
    assert [r[0] for r in L.scoped(rows, "src").collect()] == ["src/a.c", "src/nested/b.c"]
    assert L.scoped(rows, "").count() == 3


def test_names_do_not_cross_classes(spark):
    rows = spark.createDataFrame([(1, "A::run", "void run()", "a.c", 1, 2, "{}"), (2, "B::run", "void run()", "b.c", 1, 2, "{}"), (3, "run", "void A::run()", "c.c", 1, 2, "{}")], FUNCTIONS)
    asked = spark.createDataFrame([("A::run",), ("run",), ("C::run",)], "request string")
    found = {(r.request, r.function_id) for r in L.resolve_names(asked, rows).collect()}
    assert found == {("A::run", 1), ("run", 3)}


def test_innermost_function(spark):
    rows = spark.createDataFrame([(1, "outer", "", "src/sample.cpp", 1, 20, ""), (2, "second", "", "src/sample.cpp", 6, 8, "")], FUNCTIONS)
    asked = spark.createDataFrame([("r", "/work/src/sample.cpp", 7), ("s", "/work/src/sample.cpp", 15), ("t", "x.cpp", 7)], "request_id string, path string, line int")
    assert {r.request_id: r.name for r in L.containing_function(asked, rows, by_suffix=True).collect()} == {"r": "second", "s": "outer"}


def test_ambiguous_full_name_suppresses_short_name(spark):
    rows = spark.createDataFrame([(1, "f", "", "a.c", 1, 2, ""), (2, "f", "", "b.c", 1, 2, ""), (3, "N::g", "", "c.c", 1, 2, "")], FUNCTIONS)
    calls = spark.createDataFrame([("f",), ("g",), ("h",)], "callee_name string")
    assert {r.callee_name: r.callee_function_id for r in L.resolve_calls(calls, rows).collect()} == {"f": None, "g": 3, "h": None}


def test_null_returning_closure(spark):
    names = spark.createDataFrame([(n,) for n in "abcde"], "name string")
    returns = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "strlen")], "name string, returned string")
    found = {r.name: r.can_return_null for r in L.reachable_null_returners(names, returns, ["malloc"], ["strlen"]).collect()}
    assert found == {"a": True, "b": True, "c": True, "d": False, "e": False, "strlen": False}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "npd", None, True, "pending", None), (1, "npd", "", True, "confirmed", None), (1, "npd", None, True, "false_positive", None)], "scan_id int, vuln_type string, ai_verdict string, confirmed boolean, user_verdict string, review_verdict string")
    got = M.issue_metrics(rows, ["scan_id"]).first()
    assert (got.human_confirmed_count, got.human_false_positive_count, got.accuracy_basis_count, got.accuracy) == (1, 1, 3, 0.3333)
    assert one(spark, M.ratio(F.lit(1), F.lit(0))) is None


def test_dashboard(spark):
    findings = spark.createDataFrame([(1, "npd", "confirmed", "confirmed", None, True), (1, "npd", "confirmed", "confirmed", "fp", False), (1, "npd", "not_confirmed", None, None, False), (1, "oob", "confirmed", None, "tp", False)], "scan_id int, vuln_type string, ai_verdict string, user_verdict string, review_verdict string, ticket_submitted boolean").withColumn("confirmed", F.lit(False))
    scans = spark.createDataFrame([(1, "p", "x", ["npd", "oob"])], "scan_id int, project string, product string, scan_items array<string>")
    checkers = spark.createDataFrame([("npd", False), ("oob", False), ("idle", False)], "checker string, user_created boolean")
    rows = M.checker_dashboard(checkers, scans, findings)
    assert [(r.checker, r.scan_count) for r in rows.collect()] == [("npd", 1), ("oob", 1), ("idle", 0)]
    total = M.dashboard_summary(rows).first()
    assert (total.static_issue_count, total.llm_issue_count, total.fp_review_false_positive_count, total.total_issue_count, total.human_confirmed_count, total.ticket_submitted_count, total.accuracy_basis_count, total.accuracy) == (4, 3, 1, 2, 2, 1, 2, 1.0)
    assert M.checker_dashboard(checkers, scans, findings, "other").filter("scan_count > 0 or accuracy is not null").count() == 0


def test_latest_review_breaks_ties_by_order(spark):
    rows = spark.createDataFrame([(1, "tp", "r", "t", 1), (1, "fp", "r", "t", 2), (1, "uncertain", "r", "u", 3), (1, "tp", "no result yet", "z", 4)], "finding_id int, verdict string, reason string, created_at string, seq int")
    assert M.latest_reviews(rows, ["finding_id"], ["created_at", "seq"]).first().verdict == "fp"


def test_pages_clamp(spark):
    assert [r.id for r in M.page(spark.range(45), ["id"], 9).collect()] == list(range(40, 45))


def test_phase_machine_only_goes_forward(spark):
    rows = [("s", 1, "init"), ("s", 2, "auditing"), ("s", 3, "completed"), ("s", 4, "static_analysis"), ("s", 5, "error"), ("t", 1, "static_analysis")]
    events = spark.createDataFrame([(*r, "") for r in rows], "scan_id string, seq int, phase string, message string")
    found = {r.scan_id: (r.status, r.static_done, r.n_events) for r in E.scan_states(events).collect()}
    assert found == {"s": ("completed", True, 5), "t": ("analyzing", False, 1)}


def test_suppression_after_first_rejection(spark):
    rows = spark.createDataFrame([("x", "f", 1, False), ("x", "f", 2, True), ("x", "f", 3, False), ("x", "g", 4, False)], "vuln_type string, function string, seq int, rejected boolean")
    found = C.suppressed(rows, C.pattern_of("directory"), F.col("rejected"))
    assert [r.suppressed for r in found.orderBy("seq").collect()] == [False, False, True, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=20))
def test_first_seen_laws(spark, pairs):
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a int, b int, seq int")
    once = C.keep_first(rows, ["a", "b"], ["seq"])
    kept = sorted((r.a, r.b, r.seq) for r in once.collect())
    expected = {}
    for i, p in enumerate(pairs):
        expected.setdefault(p, i)
    assert kept == sorted((*p, i) for p, i in expected.items())
    assert sorted((r.a, r.b, r.seq) for r in C.keep_first(once, ["a", "b"], ["seq"]).collect()) == kept
    assert C.without_processed(rows, once, ("a", "b")).count() == 0


def test_memory_api(spark):
    rows = spark.createDataFrame([(1, "xmalloc", "", "alloc.c", 3, 5, "{ return malloc(n); }"), (2, "destroy_session", "", "session.c", 10, 12, "{ free(s); }"), (3, "go", "", "go.c", 1, 2, "{ run(); }")], FUNCTIONS)
    found = {r.name: r.role_hint for r in D.memory_api_candidates(rows).collect()}
    assert found == {"xmalloc": "alloc", "destroy_session": "free"}
    pairs = D.name_pairs(spark.createDataFrame([("session_create",)], "name string"), spark.createDataFrame([("session_free", 1), ("session_destroy", 2)], "name string, seq int"))
    assert [tuple(r) for r in pairs.collect()] == [("session_create", "session_destroy")]


CODE = """int f(node *p, node *q) {
    /* if (q) */
    if (!p) return 1;
    log("r->x");
    return p->a + q->next->next->next->v;
}"""


def test_detectors_see_code_only(spark):
    rows = spark.createDataFrame([(1, "f", "", "a.c", 100, 105, CODE)], FUNCTIONS)
    found = {r.metadata["subject"]: r.line for r in D.npd(rows).collect()}
    assert found == {"q": 100, "q->next": 104, "q->next->next": 104, "q->next->next->next": 104}
    chain = D.chain_npd(rows).first()
    assert (chain.metadata["subject"], chain.line) == ("q->next", 104)
    assert D.oob(rows).count() == 1 and D.oob(rows.withColumn("body", F.lit(None).cast("string"))).count() == 0


def test_released_structs(spark):
    rows = spark.createDataFrame([(1, "f", "", "a.c", 1, 9, "void f(void) {\n  session_t *s = get();\n  session_free(s);\n}")], FUNCTIONS)
    structs = spark.createDataFrame([(1, "session", "typedef struct session { char *a; char *b; int n; } session_t;"), (2, "small", "struct small { char *a; };")], "struct_id int, name string, definition string")
    got = D.released_structs(rows, structs).collect()
    assert [(r.line, r.metadata["callee"], r.metadata["members"]) for r in got] == [(3, "session_free", "2")]


def test_text_functions(spark):
    assert one(spark, T.keyword_at_boundary(F.lit("bufFree"), "free")) and not one(spark, T.keyword_at_boundary(F.lit("freedom"), "free"))
    assert one(spark, T.access_type(F.lit("g_x"), F.lit("if (g_x == 1)"))) == "write"
    assert one(spark, T.access_type(F.lit("g_x"), F.lit("use(g_x)"))) == "read"
    assert one(spark, T.minutes_of_day(F.lit("24:00"))) is None
    assert one(spark, T.fence(F.lit("a ```` b"))) == "`````"
    at = F.lit("2024-01-05 23:30:00").cast("timestamp")
    assert one(spark, T.in_time_window(at, F.lit(1320), F.lit(360), F.array(F.lit(5))))
    assert not one(spark, T.in_time_window(at, F.lit(1320), F.lit(360), F.array(F.lit(6))))


def test_json_in_text(spark):
    text = 'x {"a": 1} y [1, 2, {"b": "}"}] {"a": 2} {"c"'
    found = one(spark, J.all_json(F.lit(text)))
    assert [json.loads(r["raw"]) for r in found] == [{"a": 1}, [1, 2, {"b": "}"}], {"b": "}"}, {"a": 2}]
    assert one(spark, J.best_json(F.lit(text), {"type": "object", "required": ["a"]})) == '{"a": 2}'
    assert one(spark, J.best_json(F.lit(text), {"type": "string"})) is None
    assert J.fits([1], {"items": {"enum": [1]}, "maxItems": 1}) and not J.fits({"x": 1}, {"properties": {}, "additionalProperties": False})
    assert J.fits(3, {"oneOf": [{"type": "integer"}, {"type": "string"}]}) and not J.fits(True, {"type": "integer"})
    assert J.fits_pattern({"a": ["x"]}, {"a": [str]}) and not J.fits_pattern({"a": 1, "b": 2}, {"a": int}, extra_keys=False)


def test_required_empty(spark):
    with pytest.raises(ValueError, match="unknown"):
        C.require_empty(spark.range(1), "unknown")


LEAKS = {
    "early_exit": ("int f(int n) {\n  char *b = get();\n  if (n) {\n    return 1;\n  }\n  free(b);\n  return 0;\n}", {("b", "exit", 4)}),
    "checked": ("int f(int n) {\n  char *b = get();\n  if (b == NULL) {\n    return 1;\n  }\n  free(b);\n  return 0;\n}", set()),
    "handed_over": ("int f(box *o, int n) {\n  char *b = get();\n  if (n) {\n    o->b = b;\n    return 1;\n  }\n  free(b);\n  return 0;\n}", set()),
    "goes_on": ("int f(int n) {\n  for (;;) {\n    char *b = get();\n    if (n) {\n      continue;\n    }\n    free(b);\n  }\n}", {("b", "continue", 5)}),
    "half_a_chain": ("int f(int n) {\n  char *b = get();\n  if (n) {\n    free(b);\n  }\n  return 0;\n}", {("b", "exit", 6)}),
    "whole_chain": ("int f(int n) {\n  char *b = get();\n  if (n) {\n    free(b);\n  } else {\n    free(b);\n  }\n  return 0;\n}", set()),
    "falls_through": ("int f(int n) {\n  buf *b = get();\n  switch (n) {\n  case 1:\n    use(b);\n  default:\n    return 1;\n  }\n  drop_free(b);\n}", {("b", "exit", 7)}),
    "all_cases": ("int f(int n, buf **o) {\n  buf *b = get();\n  switch (n) {\n  case 1:\n    free(b);\n    break;\n  case 2:\n    *o = b;\n    break;\n  default:\n    free(b);\n  }\n  return 0;\n}", set()),
    "no_default": ("int f(int n) {\n  buf *b = get();\n  switch (n) {\n  case 1:\n    free(b);\n    break;\n  }\n  return 0;\n}", {("b", "exit", 8)}),
    "one_of_two": ("int f(int n) {\n  if (n) {\n    free(a);\n    return 1;\n  }\n  free(a);\n  free(b);\n  return 0;\n}", {("b", "exit", 4)}),
    "object": ("int f(port *p) {\n  data d;\n  if (!d_init(p, &d)) {\n    return 1;\n  }\n  d.b = get();\n  if (d.b == NULL)\n    return 2;\n  d_cleanup(&d);\n  return 0;\n}", {("d", "exit", 4), ("d", "exit", 8)}),
    "member_of_null": ("int f(box *o) {\n  if (o == MY_NULL) return 1;\n  close_it(o->b);\n  return 0;\n}", set()),
    "member": ("int f(box *o, int n) {\n  if (n) return 1;\n  close_it(o->b);\n  return 0;\n}", {("o->b", "exit", 2)}),
    "loop_then_return": ("int f(int n) {\n  for (int i = 0; i < n; i++) {\n    char *p = get();\n    if (p == 0) continue;\n    free(p);\n  }\n  return 0;\n}", set()),
    "completed": ("int f(int run_state, int id) {\n  switch (run_state) {\n  case 1:\n    if (bad(id)) {\n      run_state = ALL_DONE;\n    } else {\n      run_state = FAILED;\n      put_id(id);\n    }\n    break;\n  default:\n    break;\n  }\n  put_id(id);\n  return 0;\n}", {("id", "completion", 5)}),
    "without_argument": ("int f(int n) {\n  if (n) goto out;\n  do_cleanup();\nout:\n  return 0;\n}", {("do_cleanup()", "exit", 2)}),
    "released_null": ("int f(int n) {\n  if (!b) {\n    free(b);\n  }\n  return 0;\n}", set()),
    "returned": ("char *f(int n) {\n  char *b = get();\n  if (n)\n    return (char *)b;\n  free(b);\n  return 0;\n}", set()),
    "else_if": ("int f(int n) {\n  if (n == 1) free(b);\n  else if (n == 2) { free(b); }\n  else use(b);\n  return 0;\n}", {("b", "exit", 5)}),
    "do_while": ("int f(int n) {\n  do {\n    if (n) { continue; }\n    free(b);\n  } while (n);\n  return 0;\n}", {("b", "continue", 3)}),
    "initialiser": ("int f(int n) {\n  int a[] = {1, {2}, 3};\n  if (n) { return 1; }\n#define X if (n) return 2;\n  free(b);\n}", {("b", "exit", 3)}),
    "broken_off": ("int f(int n) {\n  if (n) { return 1;", set()),
    "switch": ("int f(int n) {\n  char *b = get();\n  switch (n) {\n  case 1:\n    return 1;\n  default:\n    free(b);\n    break;\n  }\n  return 0;\n}", {("b", "exit", 5)}),
}


def test_leaks(spark):
    from auditspark.operators.leaks import leaks

    rows = spark.createDataFrame([(i, name, "", "a.c", 1, 20, body) for i, (name, (body, _)) in enumerate(LEAKS.items())], FUNCTIONS)
    found = {name: set() for name in LEAKS}
    for r in leaks(rows).collect():
        found[list(LEAKS)[r.function_id]].add((r["var"], r.kind, r.line))
    assert found == {name: expected for name, (_, expected) in LEAKS.items()}


def test_leak_candidates(spark):
    """One candidate a function; a place names what it leaves held and where that is released."""
    from auditspark.operators.leaks import memleak

    body = "void g(int m) {\n  char *p = get(), *q = get();\n  if (m == 1) {\n    return;\n  }\n  if (m == 2) {\n    return;\n  }\n  release_buffer(p);\n  destroy_buffer(q);\n}"
    rows = spark.createDataFrame([(1, "g", "", "a.c", 11, 30, body), (2, "none", "", "a.c", 1, 2, None), (3, "h", "", "a.c", 1, 20, LEAKS["early_exit"][0])], FUNCTIONS)
    found = {r.function: r for r in memleak(rows).collect()}
    assert set(found) == {"g", "h"} and found["g"].line == 14 and found["g"].related_functions == ["destroy_buffer", "release_buffer"]
    assert found["g"].description == "2 places to check:\n1. line 14: exit before release: p (released at 19), q (released at 20)\n2. line 17: exit before release: p (released at 19), q (released at 20)"


def test_leaks_of_long_functions():
    """Many branches and deep ones take linear work: states are united, not listed."""
    import time

    from auditspark.functions.c_code import blanked, tokens
    from auditspark.operators.leaks import operations, run

    began = time.process_time()
    for body, found in (("if (x) { g(); }\n" * 20_000 + "return 1; free(p);", 1), ("if (a) {" * 20_000 + "free(p);" + "}" * 20_000 + "return 1;", 1), ("if (a) free(p); else " * 5_000 + "x(); return 1;", 1), ("int a[] = {" + "{1, 2}," * 50_000 + "}; free(p);", 0), ("(" * 50_000 + "; free(p);", 0)):
        tok, lines, _ = tokens(blanked("int f() {" + body + "}"))
        assert len(run(operations(tok, lines, [])[0], "p")) == found
    assert time.process_time() - began < 20


def test_continuation(spark):
    """A retry without a stored candidate stays; of stored rows with its key the last one stands for it; placeholders go."""
    from auditspark.operators import candidates as C

    row = lambda n, seq, kind="npd", source=None, text="": (f"f{n}.c", n, f"fn{n}", kind, seq, text, {"source": source} if source else None)
    schema = "file string, line int, function string, vuln_type string, seq int, description string, metadata map<string,string>"
    stored = spark.createDataFrame([row(1, 1), row(1, 2), row(2, 3, text="first"), row(2, 4, text="last"), row(3, 5, "Threat_Audit"), row(4, 6, source="Threat_Analysis "), row(5, 7)], schema)
    processed = spark.createDataFrame([row(2, 0), row(5, 0)], schema).select("file", "line", "function", "vuln_type")
    retries = spark.createDataFrame([row(2, 1, text="retry"), row(9, 2, text="retry"), row(9, 3, text="again"), row(1, 4, text="retry")], schema).drop("metadata")
    found = {(r.line, r.seq, r.description) for r in C.continuable(stored, processed, retries).collect()}
    assert found == {(1, 1, ""), (2, 4, "last"), (9, 2, "retry")}


def test_tasks_of_trees(spark):
    from auditspark.operators import results as R

    tree = ("s1", 0, None, " ", "n0", [("n0", "root goal"), ("n1", "node one")], [
        ("P", "goal", " about ", [("mod a", "n1", "why"), ("mod b", None, "")], [("T1", "spoof"), ("T1", "spoof"), (None, " ")]),
        (None, None, None, [(None, "n1", None)], [("T2", "flood")]),
        ("Q", None, None, [], []),
    ])
    trees = spark.createDataFrame([tree], R.TREE)
    modules = spark.createDataFrame([("mod a", 1, "old", [("x", "d")]), (" mod a ", 2, "steal", [("src/a", "d1"), ("src/b", "d2")]), ("mod b", 3, "steal", [("src/b", "d3"), ("src/c", "d4")])], "name string, seq int, threat string, paths array<struct<path:string,description:string>>")
    found = {(r.attack_path_id, r.pattern_id): r for r in R.tasks_of(trees, modules).collect()}
    assert set(found) == {("P", "T1"), ("P", "P-pattern-3"), ("tree-1-path-2", "T2")}
    one, three = found["P", "T1"], found["tree-1-path-2", "T2"]
    assert (one.tree_id, one.method_name, one.surface_name, one.attack_goal, one.risk_name, one.code_path, one.asset_name) == ("tree-1", "spoof", "mod a", "goal", "steal", "src/a", "unnamed asset")
    assert [tuple(p) for p in one.code_paths] == [("src/a", "d1"), ("src/b", "d2"), ("src/c", "d4")] and one.evidence == ["about", "why"]
    assert (three.surface_name, three.attack_goal, three.risk_name, three.code_path, three.evidence) == ("node one", "root goal", "unnamed risk", "", [])


def test_match_functions(spark):
    """Each detector asks for the function's name in its own order, and tells matches apart by its own captures."""
    from auditspark.operators import detectors as D

    functions = spark.createDataFrame([(1, "idx_fn", "src/a.c", 1, 50)], "function_id long, name string, file_path string, start_line long, end_line long")
    row = lambda i, message="", check="r.x", **m: (f"m{i}", "src/a.c", 5, check, message, {f"${k}": v for k, v in m.items()})
    schema = "match_id string, path string, line int, check_id string, message string, metavars map<string,string>"

    def names(detector, *rows, **k):
        return [(r.function, r.metadata["subject"]) for r in D.from_matches(spark.createDataFrame(rows, schema), functions, detector, **k).orderBy("function").collect()]

    assert names("intoverflow", row(1, "Function=`m`", FUNC="f", A="a", B="b", CALL="memcpy")) == [("idx_fn", "a +/-/* b")]
    assert names("safe_mem_oob", row(1, "Function=`msg` x", FUNC="$F", DST="d")) == [("msg", "d")] and names("safe_mem_oob", row(1, "none", DST="d")) == [("unknown", "d")]
    assert names("bufoverflow", row(1, "函数 zh_fn 中"), row(2, "函数 zh_fn 中", P="p"), row(3, "", FUNC="f"))[0] == ("f", "x")
    assert names("inf_loop", row(1, "Function=`q`", F="unknown"), row(2, "Function=`q`")) == [("q", "x")] and names("inf_loop", row(1)) == [("idx_fn", "x")]
    assert names("mp_npd", row(1, "Function `either` z", FUNC="ignored", P="p", ROOT="r")) == [("either", "p")]
    returners = spark.createDataFrame([("never", False), ("may", True)], "name string, can_return_null boolean")
    rows = [row(1, CALL="never", P="p"), row(2, CALL="may", P="p"), row(3, CALL="strange", P="p"), row(4, check="r.param-assign", CALL="never", P="q")]
    assert sorted(s for _, s in names("npd_funcret", *rows, null_returners=returners)) == ["may", "never", "strange"]


def test_registry(spark):
    """Rules by name: with a detector, of the user's own, and with a manifest only."""
    import pytest

    from auditspark.operators import registry as G

    functions = spark.createDataFrame([(1, "f", "", "a.c", 1, 20, LEAKS["early_exit"][0]), (2, "g", "", "b.c", 5, 6, "int g(T *p) {\n  return p->a;\n}")], FUNCTIONS)
    sources = G.Sources(functions)
    manifests = spark.createDataFrame([("memleak", True), ("npd", True), ("own_rule", True), ("oob", False)], "name string, enabled boolean")
    found = {(r.vuln_type, r.file, r.function) for r in G.run_manifests(manifests, sources).collect()}
    assert {("memleak", "a.c", "f"), ("npd", "b.c", "g"), ("own_rule", ".", "<project>")} <= found and not any(v == "oob" for v, *_ in found)
    assert G.run_rules(["own_rule"], sources).first().line == 1
    G.register("own_rule", lambda s: s.functions.selectExpr("file_path AS file", "int(start_line) AS line", "name AS function", "'' AS description", "'' AS vuln_type", "array('x') AS related_functions", "map('k', 'v') AS metadata"))
    try:
        assert {r.function for r in G.run_rules(["own_rule", "own_rule"], sources).collect()} == {"f", "g"}
        with pytest.raises(ValueError):
            G.register("own_rule", lambda s: s.functions)
    finally:
        del G.DETECTORS["own_rule"]
    for name in ("multi_ptr_leak2", "resleak", "mp_npd"):
        with pytest.raises(ValueError):
            G.run_rules([name], sources)


def test_innermost_of_long_intervals(spark):
    """A function of 2**31 lines is a few rows of the index; a file of most requests, and lines at the ends of functions."""
    import random

    from auditspark.operators import lookup as L

    rng = random.Random(6)
    functions = [(0, "all", "big.c", 0, 2**31 - 1), (1, "none", "big.c", 50, 40), (2, "twin", "big.c", 100, 200), (3, "twin2", "big.c", 100, 200)]
    functions += [(10 + i, f"f{i}", "big.c" if i % 3 else "src/small.c", a := rng.randrange(2**rng.randrange(1, 32)), a + rng.randrange(2**rng.randrange(1, 31))) for i in range(120)]
    lines = {rng.randrange(2**rng.randrange(1, 32)) for _ in range(300)} | {x for f in functions for x in f[3:5]}
    requests = [(i, "big.c" if i % 4 else rng.choice(["src/small.c", "none.c"]), line) for i, line in enumerate(sorted(lines))]
    fs = spark.createDataFrame(functions, "function_id long, name string, file_path string, start_line long, end_line long")
    covers = fs.filter("start_line <= end_line").selectExpr("function_id", "start_line", "end_line").withColumn("n", F.explode(L.dyadic_nodes("start_line", "end_line")))
    spans = {}
    for r in covers.collect():
        spans.setdefault(r.function_id, []).append((r.n.node << r.n.level, (r.n.node + 1 << r.n.level) - 1))
    for number, _, _, a, b in functions:
        if a <= b:
            parts = sorted(spans[number])
            assert parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:])) and len(parts) <= 64
    expected = set()
    for i, path, line in requests:
        inside = [(b - a, p, a, n) for n, _, p, a, b in functions if p == path and a <= line <= b]
        expected |= {(i, min(inside)[3])} if inside else set()
    asked = spark.createDataFrame(requests, "request_id long, path string, line long")
    assert {(r.request_id, r.function_id) for r in L.containing_function(asked, fs).collect()} == expected
    prefixed = asked.withColumn("path", F.concat(F.when(F.col("request_id") % 2 == 0, "/build/").otherwise(""), "path"))
    assert {(r.request_id, r.function_id) for r in L.containing_function(prefixed, fs, by_suffix=True).collect()} == expected
    short = asked.filter("path = 'src/small.c'").withColumn("path", F.lit("small.c"))
    assert {(r.request_id, r.function_id) for r in L.containing_function(short, fs, by_suffix=True).collect()} == {e for e in expected if requests[e[0]][1] == "src/small.c"}


def test_resolved_globals_of_hot_names(spark):
    from auditspark.operators import joins, lookup

    variables = [(i, f"v{i % 5}", i % 7, i % 3 == 0) for i in range(60)] + [(900, "only_static", 1, True)]
    references = [(i, "v0" if i % 2 else f"v{i % 6}", i % 9) for i in range(2_000)] + [(5_000, "only_static", 3), (5_001, None, 1)]
    expected = {}
    for i, name, file in references:
        of = [v for v in variables if v[1] == name]
        best = min(((0 if s and f == file else 1 if not s else 2), g) for g, _, f, s in of)[1] if of else None
        expected[i] = best
    vs, rs = spark.createDataFrame(variables, "global_id long, name string, file_id long, is_static boolean"), spark.createDataFrame(references, "ref_id long, name string, file_id long")
    assert joins.HUB < 1_000
    assert {r.ref_id: r.global_id for r in lookup.resolve_globals(rs, vs).collect()} == expected


def test_comments_are_blanked_without_python(spark):
    """As the tokenizer's own function does it, on odd code too, and by expressions alone."""
    import random

    from auditspark.functions.c_code import blanked
    from auditspark.operators import detectors

    rng = random.Random(6)
    parts = ["/*", "*/", "//", "\n", '"', "'", "\\", "\\\n", "a", " ", "/", "*", "é", "\U0001f600", "x->y"]
    codes = ["", None, "/* open", '"' + "\\n" * 50_000 + '"', "/*" + "ab\n" * 50_000, *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3_000))]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").withColumn("found", detectors.blank_comments("code"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert all(r.found == (None if r.code is None else blanked(r.code, directives=False)) for r in rows.collect())


def test_hot_pattern_stays_where_it_is(spark):
    """The rows of a hot pattern meet its first rejection by a broadcast; a join by the pattern alone would gather them."""
    from pyspark.sql import functions as F

    from auditspark.operators import candidates

    rows = spark.range(20_000).selectExpr("id AS seq", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 500 = 1 THEN concat('p', id) ELSE 'hot' END AS vuln_type")
    found = candidates.suppressed(rows, ["vuln_type"], F.col("seq") == 5_000)
    assert "_heavy" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("suppressed").count() == rows.filter("vuln_type = 'hot' AND seq > 5000").count() > 0 and found.count() == 20_000


def test_matches_of_one_place_are_looked_up_once(spark, monkeypatch):
    from auditspark.operators import detectors

    asked, real = [], detectors.containing_function
    monkeypatch.setattr(detectors, "containing_function", lambda requests, *a, **k: asked.append(requests.count()) or real(requests, *a, **k))
    matches = spark.range(3_000).selectExpr("id AS match_id", "concat('src/f', id % 3, '.c') AS path", "CAST(id % 5 AS INT) AS line", "'r.x' AS check_id", "'m' AS message", "CAST(map('$P', concat('p', id)) AS MAP<STRING,STRING>) AS metavars")
    functions = spark.createDataFrame([(1, "low", "f0.c", 1, 2), (2, "all", "f0.c", 1, 9)], "function_id long, name string, file_path string, start_line int, end_line int")
    found = {(r.file, r.line, r.function): r["count"] for r in detectors.from_matches(matches, functions, "bufoverflow").groupBy("file", "line", "function").count().collect()}
    assert asked == [15] and sum(found.values()) == 3_000
    assert {(line, name) for file, line, name in found if file == "src/f0.c"} == {(1, "unknown"), (1, "low"), (2, "low"), (3, "all"), (4, "all")} and all(n == "unknown" for f, _, n in found if f != "src/f0.c")


def test_matches_are_compiled(spark, monkeypatch):
    """No method of a detector's plan is beyond the 8,000 bytes that the JVM compiles, places of matches or none are null, and few
    places give the same as many."""
    from auditspark.operators import detectors as D

    held = "map('$P', concat('p', id % 3), '$IDX', IF(id % 2 = 0, ' i ', ' '), '$BASE', IF(id % 5 = 0, 'b', NULL), '$OFF', IF(id % 7 = 0, 'o', NULL), '$FIELD', 'f')"
    schema = ["id AS match_id", "IF(id % 11 = 0, NULL, concat('src/f', id % 3, '.c')) AS path", "CAST(IF(id % 13 = 0, NULL, id % 5 - 1) AS INT) AS line", "'r.x' AS check_id", "'m' AS message"]
    matches = spark.range(400).selectExpr(*schema, f"CAST({held} AS MAP<STRING,STRING>) AS metavars")
    functions = spark.createDataFrame([(1, "low", "f0.c", 0, 2), (2, "all", "f0.c", 0, 9)], "function_id long, name string, file_path string, start_line int, end_line int")
    for detector in ("intoverflow", "loop_mut_idx_oob"):
        found = D.from_matches(matches, functions, detector)
        whole = found.collect()
        sizes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
        assert max(sizes.apply(i)._3().maxMethodCodeSize() for i in range(sizes.size())) <= 8_000
    places = {(r.file, r.line): r.function for r in whole}
    assert places["src/f0.c", 3] == "all" and places["src/f1.c", 3] == "unknown" and any(f is None for f, _ in places)
    assert {"b[i]", "b[i +/- o]", "(p1 +/- i)->f", "p2->f"} <= {r.metadata["memory"] for r in whole}
    monkeypatch.setattr(D, "FEW_FACTS", 0)
    assert sorted(map(str, D.from_matches(matches, functions, "loop_mut_idx_oob").collect())) == sorted(map(str, whole))


def test_json_is_cut_before_python(spark):
    from auditspark.functions import json_text as J

    texts = ["x" * 1_000 + ' {"k": 1} tail', "no brackets", None, "] [", "\ufeff [1] é {\"k\": 2}", "😀é [[1], 2] x ]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", J.bracketed(rows.t).alias("cut"), J.best_json(rows.t).alias("best"), J.all_json(rows.t).alias("all")).collect()
    assert [r.cut for r in found] == ['{"k": 1}', "", None, "", '[1] é {"k": 2}', "[[1], 2] x ]"]
    assert [r.best for r in found] == ['{"k": 1}', None, None, None, '{"k": 2}', "[[1], 2]"]
    assert all(r["all"] is not None and all(r.t[v.pos : v.pos + v.len] == v.raw for v in r["all"]) for r in found) and len(found[-1]["all"]) == 2


def largest_task(rows):
    return rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_reviews_of_jobs_are_dealt_by_their_number(spark, monkeypatch):
    from auditspark.operators import results as R

    monkeypatch.setattr(R, "ROWS", 100)
    reviews = spark.range(6_000).selectExpr("id % 1500 AS job", "id AS seq")
    jobs = spark.range(1_400).selectExpr("id AS job", "'P' AS status", "id AS created_at")
    found = R.reviews_of_jobs(reviews, jobs)
    assert largest_task(found) < 400
    assert {(r.job, r.seq, r.place) for r in found.collect()} == {(i % 1500, i, i // 1500 + 1) for i in range(6_000) if i % 1500 < 1_400}


def test_tasks_of_trees_are_dealt_by_their_number(spark, monkeypatch):
    from auditspark.operators import results as R

    path = "named_struct('path_id', concat('P', {p}), 'path_name', '', 'path_description', '', 'related', array(named_struct('module_name', concat('m', {p} % 5), 'node_id', CAST(NULL AS STRING), 'association', '')), 'patterns', transform(array(0, 1, 0), i -> named_struct('pattern_id', concat('T', i), 'pattern_name', 'n')))"
    # Paths 0 and 9 of each tree have one id.
    trees = spark.range(300).selectExpr("concat('s', id) AS scan_id", "0L AS seq", "CAST(NULL AS STRING) AS tree_id", "'' AS asset_name", "'' AS root_node_id", "CAST(array() AS array<struct<node_id:string,node_name:string>>) AS nodes", f"transform(sequence(0, 9), p -> {path.format(p='(p % 9)')}) AS attack_paths")
    modules = spark.range(4).selectExpr("concat('m', id) AS name", "id AS seq", "'t' AS threat", "array(named_struct('path', concat('c', id), 'description', '')) AS paths")
    columns = ["scan_id", "attack_path_id", "pattern_id", "code_path", "task_id"]
    whole = sorted(map(tuple, R.tasks_of(trees, modules).select(*columns).collect()))
    monkeypatch.setattr(R, "WIDE_ROWS", 100)
    for found in (R.tasks_of(trees, modules), R.tasks_of(trees, modules, 3_000)):
        assert largest_task(found) < 600
        assert sorted(map(tuple, found.select(*columns).collect())) == whole
    assert {r[:4] for r in whole} == {(f"s{s}", f"P{p}", f"T{i}", f"c{p % 5}" if p % 5 < 4 else "") for s in range(300) for p in range(9) for i in (0, 1)} and len(whole) == 5_400

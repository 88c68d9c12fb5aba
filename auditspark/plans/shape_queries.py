"""Queries of parsers and detectors over code of many shapes, with what each shape must give as a table of literals.

A row of the driver's table takes the shape that its key names; the SQL side looks the answer up, so nothing of it is made by
the code under test. Shapes include those that must give nothing. Detectors and parsers of bodies run over the documents: a
shape stands before the document's whole text, which is a comment that the code under test has to read and pass over.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions import text as T
from ..operators import detectors as D
from ..operators import index as I
from ..operators.leaks import body_ends
from ..operators.leaks import leaks as find_leaks
from ..operators.lookup import path_suffix_equal
from ..sources import readers as R
from ..sources import writers as W
from .views import Queries, scratch, table

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql


def literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


#: A document's text as what follows the code of a shape: a comment.
COMMENT = "concat(chr(10), '/* ', replace(replace(coalesce(text, ''), '*/', '* /'), chr(0), ' '), ' */')"


def functions_of(spark, sf, bodies: list[str]):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("function_id"), (F.col("doc_id") % len(bodies)).alias("shape"), F.expr(COMMENT).alias("rest"))
    body = F.concat(F.element_at(F.array(*map(F.lit, bodies)), (F.col("shape") + 1).cast("int")), F.col("rest"))
    return rows.select("function_id", F.concat(F.lit("fn"), F.col("function_id").cast("string")).alias("name"), F.concat(F.lit("f"), F.col("function_id").cast("string"), F.lit(".c")).alias("file_path"), F.lit(10).cast("long").alias("start_line"), F.lit(40).cast("long").alias("end_line"), body.alias("body"))


def detected(name: str, cases: list[tuple[str, list[tuple]]], columns: list[str], detect):
    """Registers a detector's query: its findings on the document's shape. cases: a body, and rows of line and further columns."""
    rows = ", ".join("(" + ", ".join(map(literal, (i, *row))) + ")" for i, (_, found) in enumerate(cases) for row in found)
    names = ", ".join(columns)

    def query(spark, sf):
        return detect(spark, functions_of(spark, sf, [b for b, _ in cases])).select("function", *columns)

    Q.add(name, f"WITH answers(shape, {names}) AS (VALUES {rows}) SELECT concat('fn', CAST(doc_id AS STRING)) AS function, {names} FROM documents JOIN answers ON shape = doc_id % {len(cases)}")(query)


def in_texts(name: str, cases: list[tuple], apply, kind: str = "VARCHAR", before: str = "''", after: str = "''"):
    """Registers a query over the documents: a shape between what two SQL expressions make of the text. cases: the shape,
    further inputs, and the answer."""
    answers = ", ".join(f"({i}, {literal(c[-1])})" for i, c in enumerate(cases))

    def query(spark, sf):
        at = (F.col("doc_id") % len(cases) + 1).cast("int")
        columns = [F.element_at(F.array(*[F.lit(c[i]) for c in cases]), at) for i in range(len(cases[0]) - 1)]
        columns[0] = F.concat(F.expr(before), columns[0], F.expr(after))
        rows = table(spark, sf, "documents").select("doc_id", *(c.alias(f"input{i}") for i, c in enumerate(columns)))
        return rows.select("doc_id", apply(*[F.col(f"input{i}") for i in range(len(columns))]).alias("answer"))

    Q.add(name, f"WITH answers(shape, answer) AS (VALUES {answers}) SELECT doc_id, CAST(answer AS {kind}) AS answer FROM documents JOIN answers ON shape = doc_id % {len(cases)}")(query)


#: A document's text without what the parsers look for.
NO_BRACKETS = "concat(translate(coalesce(text, ''), '{}[]\"\\\\', '      '), ' ')"
NO_CODE = "concat(chr(10), translate(coalesce(text, ''), '#\\\\!=>&|()?', '          '))"


def subject(found):
    return found.withColumn("subject", F.col("metadata")["subject"]).withColumn("line", F.col("line").cast("int"))


#: Two paths, in which @ stands for a document's own, and whether they may be one.
PATHS = [
    ("src/@", "@", True), ("src\\@", "@", True), ("@", "/work/src/@", True), ("@", "@", True), ("x@", "@", False), ("src/@c", "@", False),
    ("a.c", "src/lib/a.c", True), ("", "@", False), ("src/@/b/a.c", "@", False), ("Src/@", "src/@", False), ("./@", "@", True), ("b/a.c", "c/a.c", False),
]
_MAY = ", ".join(f"({i}, {literal(p[-1])})" for i, p in enumerate(PATHS))


@Q.add("str24_path_variants", f"WITH answers(shape, answer) AS (VALUES {_MAY}) SELECT doc_id, answer FROM documents JOIN answers ON shape = doc_id % {len(PATHS)}")
def path_variants(spark, sf):
    at, own = (F.col("doc_id") % len(PATHS) + 1).cast("int"), F.concat("source", F.lit("/"), "lang", F.lit(".c"))
    side = lambda i: F.replace(F.element_at(F.array(*[F.lit(p[i]) for p in PATHS]), at), F.lit("@"), own)
    return table(spark, sf, "documents").select("doc_id", path_suffix_equal(side(0), side(1)).alias("answer"))


in_texts("str16_macros", [
    ("#define A 1", "A"), ("  #  define B(x) (x)\n#define C", "B,C"), ("#define D \\\n#define NOT\n#define E 2", "D,E"), ("int x; #define NO", ""), ("#undef F", ""), ("#define_G 1", ""), ("#define\tH\t1\r\n#define I", "H,I"), ("", ""),
    ("// text\n#define _J2 x", "_J2"), ("#define 2K", ""), ("#define L(a, b) \\\r\n  a + b\n#define M", "L,M"), ("#ifdef N\n#define O\n#endif", "O"),
], lambda a: F.array_join(T.macro_names(a), ","), after=NO_CODE)

in_texts("str09_chain_guard", [
    ("if (!p->a) return;", "p->a", True), ("if (p -> a == NULL)", "p->a", True), ("if (NULL == p->a)", "p->a", True), ("if (p->a != nullptr && x)", "p->a", True), ("assert(p->a != 0);", "p->a", True), ("if (p->a)", "p->a", True), ("if (p->a && p->a->b)", "p->a", True),
    ("if (!p->a->b)", "p->a", False), ("if (x) y = p->a;", "p->a", False), ("return !p->a || z;", "p->a", True), ("if (p->a[0] == NULL)", "p->a", False), ("if ( p->a[ 0 ] == NULL )", "p->a[0]", True), ("if (q->p->a)", "p->a", False), ("while (p->a)", "p->a", False), ("assert(p->a->b)", "p->a", True), ("if (p->ab)", "p->a", False),
], T.chain_guarded, "BOOLEAN", after=NO_CODE)

in_texts("jsn02_best_json", [
    ('{"k": 1}', '{"k": 1}'), ('x {"k": 1} y {"k": 2} z', '{"k": 2}'), ('{"k": 10} {"k": 2}', '{"k": 10}'), ('{"x": 1}', None), ("", None), ('{"k": "1"}', None), ('[{"k": 7}]', '{"k": 7}'), ('```json\n{"k": 3,\n "z": [1, 2]}\n```', '{"k": 3,\n "z": [1, 2]}'),
    ('{"k": 1, {"k": 2}', '{"k": 2}'), ('{"a": {"k": 5}}', '{"k": 5}'), ('{"k": 1.5}', None), ('{"k": true}', None), ('{"k": 1} [1, 2, 3, 4, 5, 6, 7]', '{"k": 1}'),
], lambda a: J.best_json(a, {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}), before=NO_BRACKETS)

in_texts("jsn04_type_pattern", [
    ('{"k": 3, "l": ["a"]}', '{"k": 3, "l": ["a"]}'), ('{"k": 3, "l": []}', '{"k": 3, "l": []}'), ('{"k": "3", "l": []}', None), ('{"k": 3}', None), ('{"k": 3, "l": [1]}', None), ('{"k": 3, "l": "a"}', None), ('{"k": null, "l": ["a"]}', '{"k": null, "l": ["a"]}'), ('{"k": true, "l": []}', None),
    ('{"k": 3, "l": ["a"], "m": 1}', '{"k": 3, "l": ["a"], "m": 1}'), ("[3]", None), ('text {"k": 4, "l": ["b", "c"]}', '{"k": 4, "l": ["b", "c"]}'), ("{}", None),
], lambda a: J.best_json(a, pattern={"k": (int, type(None)), "l": [str]}), before=NO_BRACKETS)

@Q.add("jsn05_tolerant_decode", "SELECT doc_id, CAST(CASE doc_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS INT) AS answer FROM documents")
def tolerant_decode(spark, sf):
    """Lists of whole texts, and what is none: an object, a list that breaks off, a string, the text as it is, nothing."""
    text, shape = F.coalesce("text", F.lit("")), F.col("doc_id") % 9
    whole = F.to_json(F.array(text, F.lit("b")))
    made = [F.to_json(F.array(text)), whole, F.to_json(F.array(text, F.lit(None).cast("string"))), F.to_json(F.struct(text.alias("a"))), F.substring(whole, F.lit(1), F.length(whole) - 1), F.concat(F.lit('"'), F.to_json(F.array(text)), F.lit('"')), F.concat(F.lit("no json: "), text), F.lit(""), F.lit(None).cast("string")]
    picked = F.coalesce(*(F.when(shape == i, m) for i, m in enumerate(made)))
    return table(spark, sf, "documents").select("doc_id", F.size(J.string_list(picked)).alias("answer"))


P = "int fn(T *p) {\n"

detected("det_npd", [
    (P + "  return p->a;\n}", [(10, "p")]), (P + "  if (!p) return 1;\n  return p->a;\n}", []), (P + "  if (p == NULL) return 1;\n  return p->a->b;\n}", [(12, "p->a")]), ("int fn(int *q) {\n  q[2] = 1;\n}", [(10, "q")]), ("int fn(int n) {\n  return n;\n}", []),
    (P + '  /* p->a */\n  log("p->b");\n}', []), (P + "  assert(p);\n  p->a = 1;\n}", []), (P + "  g_hook(p);\n}", [(11, "g_hook")]), (P + "  if (p) { x = p->a; }\n}", []), ("int fn(T **p) {\n  *p = 0;\n}", [(10, "p")]), (P + "  this->x = 1;\n}", []),
    ("int fn(S *s) {\n  if (s->next == NULL) return 0;\n  s->next->v = 1;\n}", [(10, "s")]), ("int fn(void) {\n  if (!r->a->b) return 1;\n\n  z = r->a->b->c + w[1];\n}", [(13, "w")]),
], ["line", "subject"], lambda spark, rows: subject(D.npd(rows)))

detected("det_chain_npd", [
    (P + "  return p->a->b->c->d;\n}", [(11, "p->a")]), (P + "  return p->a->b->c;\n}", []), (P + "  return p->a[2]->b;\n}", [(11, "p->a")]), (P + "  if (!p->a) return 1;\n  return p->a->b->c->d;\n}", [(12, "p->a->b")]), (P + "  if (p->a && p->a->b) {\n    return p->a->b->c->d;\n  }\n}", [(11, "p->a->b")]),
    (P + "  q[1]->a = 2;\n}", []), (P + "  // p->a->b->c->d\n  return p->a;\n}", []), (P + "  this->a->b->c->d = 1;\n}", []), (P + "  p -> a -> b [ 3 ] -> c = 1;\n}", [(11, "p->a")]), (P + "  x = r->s->t->u->v; y = p->a[0]->b;\n}", [(11, "r->s")]),
    (P + "  assert(p->a->b->c);\n  z = p->a->b->c->d;\n}", []), (P + "  if (!p->a->b->c) return 1;\n  p->a->b->c->d = 1;\n}", [(11, "p->a")]),
], ["line", "subject"], lambda spark, rows: subject(D.chain_npd(rows)))

V = "void fn() {\n"

detected("det_atoi", [
    (V + "  n = atoi(s);\n}", [(11, "s")]), (V + "  n = ::atoi(s + 1);\n}", [(11, "s + 1")]), (V + "  n = std::atoi(get(s));\n}", [(11, "get(s)")]), (V + "  n = x.atoi(s);\n}", []), (V + "  n = p->atoi(s);\n}", []), (V + "  n = my_atoi(s);\n}", []), (V + "  // atoi(s)\n}", []),
    (V + '  log("atoi(s)");\n}', []), (V + "  n = atoi(a) + atoi(b);\n}", [(11, "a"), (11, "b")]), (V + "\n  n = atoi (s);\n}", [(12, "s")]), (V + "  n = 1;\n}", []), (V + "  n = atoi(v[i].s);\n}", [(11, "v[i].s")]),
], ["line", "argument"], lambda spark, rows: subject(D.atoi_calls(rows)).withColumn("argument", F.col("metadata")["argument"]))

detected("det_sensitive_clear", [
    (V + "  char session_key[32];\n}", [(11, "session_key:11")]), (V + "  char name[8];\n}", []), ("void fn(const char *password, int n) {\n}", [(10, "password:10")]), (V + "  int apiToken = 1, n;\n}", [(11, "apiToken:11")]), (V + "  return secret;\n}", []), (V + "  // char secret[2];\n}", []),
    (V + "  char a[2];\n  struct nonce_t iv;\n}", [(12, "iv:12")]), (V + "  u8 salt[4];\n  u8 seed;\n}", [(11, "salt:11, seed:12")]), (V + '  log("char key[1];");\n}', []), (V + "  goto pass;\n}", []),
], ["line", "subject"], lambda spark, rows: subject(D.sensitive_clear(rows)))

B = "int f(int n) {\n  char *b = get();\n"

detected("det_memleak", [
    (B + "  if (n) {\n    return 1;\n  }\n  free(b);\n  return 0;\n}", [(13, "b", "exit")]), (B + "  if (b == NULL) {\n    return 1;\n  }\n  free(b);\n  return 0;\n}", []), (B + "  if (!b) {\n    return 1;\n  }\n  free(b);\n  return 0;\n}", []), ("int f(box *o, int n) {\n  char *b = get();\n  if (n) {\n    o->b = b;\n    return 1;\n  }\n  free(b);\n  return 0;\n}", []), (B + "  if (n) {\n    global->b = b;\n    return 1;\n  }\n  free(b);\n  return 0;\n}", [(14, "b", "exit")]),
    ("int f(int n) {\n  for (;;) {\n    char *b = get();\n    if (n) {\n      continue;\n    }\n    free(b);\n  }\n}", [(14, "b", "continue")]), (B + "  if (n) {\n    free(b);\n  }\n  return 0;\n}", [(15, "b", "exit")]), (B + "  if (n) {\n    free(b);\n  } else {\n    free(b);\n  }\n  return 0;\n}", []),
    (B + "  switch (n) {\n  case 1:\n    return 1;\n  default:\n    free(b);\n    break;\n  }\n  return 0;\n}", [(14, "b", "exit")]), (B + "  return 0;\n}", []), (B + "  /* free(b); */\n  return 0;\n}", []), (B + "  if (n) {\n    return b;\n  }\n  free(b);\n  return 0;\n}", []),
    (B + "  if (n) {\n    return 1;\n  }\n  if (n > 2) {\n    return 2;\n  }\n  free(b);\n  return 0;\n}", [(13, "b", "exit"), (16, "b", "exit")]),
    (B + "  switch (n) {\n  case 1:\n    use(b);\n  default:\n    return 1;\n  }\n  free(b);\n}", [(16, "b", "exit")]), (B + "  switch (n) {\n  case 1:\n    run_state = DONE;\n    break;\n  }\n  free(b);\n  return 0;\n}", [(14, "b", "completion")]), ("int f(box *o) {\n  if (o == NULL) return 1;\n  close_it(o->b);\n  return 0;\n}", []),
    ("int f(port *p) {\n  data d;\n  if (!d_init(p, &d)) {\n    return 1;\n  }\n  d_cleanup(&d);\n  return 0;\n}", [(13, "d", "exit")]), (B + "  while (n) {\n    free(b);\n  }\n  return 0;\n}", []), (B + "  if (n) {\n    free(b);\n    return 1;\n  }\n  free(b);\n  free(c);\n  return 0;\n}", [(14, "c", "exit")]),
], ["line", "variable", "kind"], lambda spark, rows: find_leaks(rows).select(F.concat(F.lit("fn"), F.col("function_id").cast("string")).alias("function"), F.col("line").cast("int").alias("line"), F.col("var").alias("variable"), "kind"))

detected("str05_body_end", [
    ("int f() {\n  return 1;\n}\nint g;", [(12,)]), ("int f() { if (x) { y(); } }\n", [(10,)]), ('int f() {\n  puts("}");\n}\n}', [(12,)]), ("int f() {\n  // }\n}\n", [(12,)]), ("int f() {\n  c = '}';\n}\n", [(12,)]), ("int f() {\n  if (x) {\n  }\n  while (y) {\n  }\n}\nint z;", [(15,)]), ("int f()\n{\n}\n", [(12,)]),
    ("int f() {\n  /* }\n } */\n}\n", [(13,)]), ("struct s f() {\n  s a = {1, {2}};\n  return a;\n}\n", [(13,)]), ('int f() {\n  p = "\\"}";\n}\nint g() {\n}', [(12,)]),
], ["line"], lambda spark, rows: body_ends(rows).select(F.concat(F.lit("fn"), F.col("function_id").cast("string")).alias("function"), F.col("end_line").cast("int").alias("line")))

STRUCTS = [
    (1, "two", "struct two { char *a; int n; char *b; };"), (2, "one", "struct one { char *a; int n; };"), (3, "anon", "typedef struct { void *x; void *y; } pair_t;"), (4, "ns::deep", "struct deep { int **p; T *q; T *r; };"),
]

detected("jon19_released_structs", [
    (V + "  struct two *s = get();\n  free_two(s);\n}", [(12, "s")]), (V + "  struct one *s = get();\n  free_one(s);\n}", []), ("void fn(pair_t *p) {\n  pair_release(p);\n}", [(11, "p")]), (V + "  deep *d = x;\n  Destroy(d);\n}", [(12, "d")]), (V + "  struct two *s = get();\n  use(s);\n}", []), (V + "  struct two *s = get();\n  // free(s);\n}", []),
    (V + "  struct two *s = get();\n  free(s->a);\n}", []), (V + "  unknown *s = get();\n  free(s);\n}", []), ("void fn(struct two *a, struct one *b) {\n  put_obj(a);\n  put_obj(b);\n}", [(11, "a")]), (V + "  struct two *s, *t = get();\n  free(s);\n  free(s);\n}", [(12, "s"), (13, "s")]), (V + "  int s = 0;\n  free(s);\n}", []),
], ["line", "subject"], lambda spark, rows: subject(D.released_structs(rows, spark.createDataFrame(STRUCTS, "struct_id long, name string, definition string"))))


#: Sources, their tagger's entries (name, kind, line, end, further fields) and what an index of them holds: (kind, name, line,
#: detail), the detail being an end line, the function that a call is of, or how a global is used. @ is the document's number.
SOURCES = [
    ("static int g_count@ = 0;\nint fn@(int a) {\n  g_count@ = a;\n  return helper@(a) + g_count@;\n}\nint helper@(int b) { return b; }\n",
     [("g_count@", "variable", 1, 1), ("fn@", "function", 2, 5), ("helper@", "function", 6, None)],
     [("function", "fn@", 2, "5"), ("function", "helper@", 6, "6"), ("global", "g_count@", 1, "1"), ("call", "helper@", 4, "fn@ > helper@"), ("reference", "g_count@", 3, "fn@ write"), ("reference", "g_count@", 4, "fn@ read")]),
    ("void fn@(box *p) {\n  /* gone@(p); */\n  log(\"call@(1)\");\n  p->run@(1);\n  if (p) { ns::act@(p); }\n  return;\n}\n",
     [("fn@", "function", 1, None)],
     [("function", "fn@", 1, "7"), ("call", "log", 3, "fn@ > "), ("call", "run@", 4, "fn@ > "), ("call", "ns::act@", 5, "fn@ > ")]),
    ("struct s@ {\n  int x;\n};\nint g_v@;\nint fn@(int g_v@) {\n  g_v@ = 1;\n  return g_w@;\n}\nint only_declared@(int);\n",
     [("s@", "struct", 1, None), ("g_v@", "variable", 4, None), ("fn@", "function", 5, 8), ("only_declared@", "function", 9, None), ("", "function", 5, 8)],
     [("struct", "s@", 1, "3"), ("global", "g_v@", 4, "4"), ("function", "fn@", 5, "8")]),
    ("int K@::fn@(int n) {\n  for (int i = 0; i < n; i++) { g_t@[i] += step@(i); }\n  return ++g_t@;\n}\nint g_t@;\nint Q@::step@(int i) {\n  return i;\n}\n",
     [("K@::fn@", "method", 1, 4), ("g_t@", "v", 5, 5), ("Q@::step@", "f", 6, 8)],
     [("function", "K@::fn@", 1, "4"), ("function", "Q@::step@", 6, "8"), ("global", "g_t@", 5, "5"), ("call", "Q@::step@", 2, "K@::fn@ > Q@::step@"), ("reference", "g_t@", 2, "K@::fn@ write"), ("reference", "g_t@", 3, "K@::fn@ write")]),
]
_HOLDS = ", ".join(f"({i}, {literal(kind)}, {literal(name)}, {line}, {literal(detail)})" for i, (_, _, rows) in enumerate(SOURCES) for kind, name, line, detail in rows)


@Q.add("src14_index_build", f"WITH answers(shape, kind, name, line, detail) AS (VALUES {_HOLDS}) SELECT doc_id, kind, replace(name, '@', CAST(doc_id AS VARCHAR)) AS name, CAST(line AS BIGINT) AS line, replace(detail, '@', CAST(doc_id AS VARCHAR)) AS detail FROM documents JOIN answers ON shape = doc_id % {len(SOURCES)}")
def index_build(spark, sf):
    """Each document is a source file, its text a comment at the end; a tagger's output is written and read again, and so is
    the index."""
    number, at = F.col("doc_id").cast("string"), (F.col("doc_id") % len(SOURCES) + 1).cast("int")
    filled = lambda c: F.replace(c, F.lit("@"), number)
    docs = table(spark, sf, "documents")
    files = docs.select(F.concat(F.lit("src/"), number, F.lit(".c")).alias("path"), F.concat(filled(F.element_at(F.array(*[F.lit(s) for s, _, _ in SOURCES]), at)), F.expr(COMMENT)).alias("text"))
    entry = "array<struct<name:string,kind:string,line:bigint,end:bigint>>"
    entries = F.element_at(F.array(*[F.from_json(F.lit(json.dumps([dict(zip(("name", "kind", "line", "end"), t)) for t in tags])), entry) for _, tags, _ in SOURCES]), at)
    path = scratch(spark, "tags")
    rows = docs.select("doc_id", F.explode(entries).alias("t"))
    rows.select(F.to_json(F.struct(F.lit("tag").alias("_type"), filled(F.col("t.name")).alias("name"), F.concat(F.lit("src\\"), number, F.lit(".c")).alias("path"), "t.line", "t.end", "t.kind")).alias("value")).write.text(path)
    parts = scratch(spark, "parts")
    I.index_parts(files, R.read_tags(spark, path)).write.parquet(parts)
    target = scratch(spark, "index")
    W.write_index(I.index_tables(spark.read.parquet(parts), files), target, "v1")
    read = lambda name: spark.read.parquet(f"{target}/{name}")
    functions, paths = read("functions"), read("files")
    named = functions.select("function_id", F.col("name").alias("owner"))
    definitions = [read(name).select("file_path", F.lit(kind).alias("kind"), "name", F.col("start_line").alias("line"), F.col("end_line").cast("string").alias("detail")) for kind, name in (("function", "functions"), ("struct", "structs"), ("global", "globals"))]
    calls = read("calls").join(paths, "file_id").join(named.withColumnRenamed("function_id", "caller_id"), "caller_id").join(named.withColumnsRenamed({"function_id": "callee_function_id", "owner": "callee"}), "callee_function_id", "left")
    calls = calls.select("file_path", F.lit("call").alias("kind"), F.col("callee_name").alias("name"), "line", F.concat("owner", F.lit(" > "), F.coalesce("callee", F.lit(""))).alias("detail"))
    references = read("references").join(paths, "file_id").join(named, "function_id").select("file_path", F.lit("reference").alias("kind"), "name", "line", F.concat_ws(" ", "owner", "access_type").alias("detail"))
    out = definitions[0].unionByName(definitions[1]).unionByName(definitions[2]).unionByName(calls).unionByName(references)
    return out.select(F.regexp_extract("file_path", r"(\d+)\.c$", 1).cast("long").alias("doc_id"), "kind", "name", "line", "detail")

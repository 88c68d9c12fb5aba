"""Detectors: functions of the index, or matches of an external matcher, to candidates.

Comments and strings are blanked once, place by place, so that patterns see code only and line numbers stay. All else is
expressions over columns: extraction, explode, guards as anti-filters, grouping. A cheap text filter stands before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import call_names, checked_chains, checked_names, escape_regex, line_of_match, normal_expression, pair_name, role_hint, short_name, stable_id, terms_in
from .candidates import keep_first
from .joins import FEW_FACTS, join_fact
from .lookup import containing_function
from .results import Values, arithmetic, memory_place, metavar, sink

#: Names that are never pointers of interest.
SKIPPED = ("this", "NULL", "nullptr", "true", "false", "void")
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof", "case", "else", "do", "goto")


#: Comments, literals, and what lies between; the code is these pieces one after another.
PIECES = r"""(?s)(/\*.*?(?:\*/|\z)|//[^\n]*+|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|[^/"']++|.)"""


def blank_comments(code: Column | str) -> Column:
    """The code with comments and the insides of literals as blanks; lines and columns stay."""
    blank = lambda c: F.regexp_replace(c, r"[^\n]", " ")
    quoted = lambda p: (F.length(p) > 1) & (p.startswith('"') | p.startswith("'"))
    inside = lambda p: F.concat(F.substring(p, 1, 1), blank(F.substring(p, F.lit(2), F.length(p) - 2)), F.substring(p, -1, 1))
    shown = lambda p: F.when(p.startswith("/*") | p.startswith("//"), blank(p)).when(quoted(p), inside(p)).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(PIECES), F.lit(1)), shown), "")


def once(value: Column) -> Column:
    """The value as a generator's only row, so that no filter or later column is made to work it out again."""
    return F.explode(F.array(value))


def candidate(file: Column, line: Column, function: Column, vuln_type: str, subject: Column, description: Column, **metadata: Column) -> list[Column]:
    entries = [x for k, v in (("subject", subject), *metadata.items()) for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return [file.alias("file"), line.cast("int").alias("line"), function.alias("function"), description.alias("description"), F.lit(vuln_type).alias("vuln_type"), F.array().cast("array<string>").alias("related_functions"), F.create_map(*entries).alias("metadata")]


def oob(functions: DataFrame) -> DataFrame:
    """Every function with a body."""
    found = functions.filter(F.coalesce(F.col("body"), F.lit("")) != "")
    return found.select(*candidate(F.col("file_path"), F.col("start_line"), F.col("name"), "oob", F.col("name"), F.concat(F.lit("Does "), F.col("name"), F.lit(" access memory out of bounds?"))))


def project_rule(name: str) -> DataFrame:
    """One project-level row of a rule that has a manifest only."""
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(*candidate(F.lit("."), F.lit(1), F.lit("<project>"), name, F.lit(name), F.lit("Audit the project for this rule.")))


def lines_of(functions: DataFrame, code: str = "code") -> DataFrame:
    """One row a line: the function's columns, line (absolute) and text."""
    split = functions.select("*", F.posexplode(F.split(code, "\r?\n")).alias("_at", "text"))
    return split.withColumn("line", F.col("start_line") + F.col("_at")).drop("_at")


def atoi_calls(functions: DataFrame) -> DataFrame:
    """Calls of ``atoi``, also as ``::atoi`` or in a namespace, with their argument."""
    hinted = functions.filter(F.col("body").contains("atoi")).withColumn("code", once(blank_comments("body")))
    calls = lines_of(hinted).filter(F.col("text").contains("atoi"))
    # The code before each call that is no member access, to its end: column and argument follow.
    pattern = r"(?<![\w.>])((?:\w*::)*atoi\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\))"
    found = calls.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", "call"))
    found = found.withColumn("argument", F.trim(F.regexp_extract("call", r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", 1)))
    found = found.dropDuplicates(["file_path", "line", "nth", "argument"])
    subject = F.coalesce(F.nullif("argument", F.lit("")), F.col("call"))
    return found.select(*candidate(F.col("file_path"), F.col("line"), F.col("name"), "atoi_read_oob", subject, F.concat(F.lit("May atoi read past the end of "), subject, F.lit("?")), call=F.col("call"), argument=F.col("argument")))


def dereferenced(code: Column) -> tuple[Column, Column]:
    """Two arrays: names used as pointers, and g_ names that are called."""
    one = lambda pattern: F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    arrows, stars = one(r"([A-Za-z_]\w*(?:(?:->|\.)\w+)*)\s*->"), one(r"(?<![\w)\]]\s?)\*\s*\(?\s*([A-Za-z_]\w*)\b(?!\s*[(*])")
    subscripts, hooks = one(r"([A-Za-z_]\w*(?:(?:->|\.)\w+)*)\s*\["), one(r"(?:->|\.|::)?\b(g_\w+)\s*\(")
    names = F.array_distinct(F.concat(_steps(arrows), stars, subscripts))
    skipped = F.array(*map(F.lit, (*SKIPPED, *KEYWORDS)))
    return F.array_except(names, skipped), F.array_except(F.array_distinct(hooks), names)


def _steps(chains: Column) -> Column:
    """a->b->c dereferences a and a->b, and so on: each chain as far as each of its arrows."""
    steps = lambda chain: F.split(chain, "->")
    return F.flatten(F.transform(chains, lambda chain: F.transform(F.sequence(F.lit(1), F.size(steps(chain))), lambda i: F.array_join(F.slice(steps(chain), F.lit(1), i), "->"))))


def _shown_on(text: Column) -> Column:
    """Names that a line shows where they are used as pointers or called."""
    one = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    chain = r"([A-Za-z_]\w*(?:(?:->|\.)\w+)*)"
    return F.concat(_steps(one(chain + r"[ \t]*->")), one(r"\*[ \t]*([A-Za-z_]\w*)"), one(chain + r"[ \t]*\["), one(chain + r"[ \t]*\("), one(r"\b(g_\w+)[ \t]*\("))


def npd(functions: DataFrame) -> DataFrame:
    """Names that a function uses as pointers and never checks, at the first line that shows them.

    Names, checks and lines come from constant patterns, once a function or line; only names and numbers are shuffled.
    """
    keys = ["function_id", "file_path", "name", "start_line"]
    rows = functions.filter(F.col("body").rlike(r"->|\*|\[|\bg_\w+\s*\(")).withColumn("code", once(blank_comments("body")))
    names, hooks = dereferenced(F.col("code"))
    rows = rows.select(*keys, "code", names.alias("names"), hooks.alias("hooks"), checked_names(F.col("code")).alias("checked"))
    rows = rows.select(*keys, "code", F.array_except("hooks", "checked").alias("hooks"), F.array_except(F.concat("names", "hooks"), "checked").alias("open"))
    # Each open name once without a line, and once for each line that shows it; a body is read once for all of them.
    place = lambda v, line: F.struct(v.alias("variable"), line.cast("long").alias("line"))
    shown = F.transform(F.split("code", "\r?\n"), lambda text, i: F.transform(F.array_intersect(_shown_on(text), F.col("open")), lambda v: place(v, F.col("start_line") + i)))
    every = F.transform("open", lambda v: place(v, F.lit(None)))
    found = rows.select(*keys, "hooks", F.inline(F.concat(every, F.flatten(shown))))
    found = found.select(*keys, "variable", "line", F.array_contains("hooks", F.col("variable")).alias("called"))
    found = found.groupBy(*keys, "variable").agg(F.coalesce(F.min("line"), "start_line").alias("line"), F.max("called").alias("called"))
    # A g_ name that is called may be a function of the index; one that is dereferenced is none.
    known = functions.filter(F.col("name").startswith("g_")).select(F.col("name").alias("variable"), F.lit(True).alias("_known")).distinct()
    found = found.join(known, "variable", "left").filter(~(F.col("called") & F.coalesce("_known", F.lit(False))))
    return found.select(*candidate(F.col("file_path"), F.col("line"), F.col("name"), "npd", F.col("variable"), F.concat(F.lit("May "), F.col("variable"), F.lit(" be null where it is dereferenced?"))))


def chain_npd(functions: DataFrame) -> DataFrame:
    """The first inner expression of a member chain, of over three members or with a subscript, that is never checked.

    All of it is expressions over a function's own row; nothing is shuffled.
    """
    rows = functions.filter(F.col("body").contains("->")).withColumn("code", once(blank_comments("body")))
    chain = r"([A-Za-z_]\w*(?:\s*->\s*[A-Za-z_]\w*|\s*\[[^\[\]]*\])+)"
    root = lambda c: F.regexp_extract(c, r"^([A-Za-z_]\w*)", 1)
    links = lambda c: F.regexp_extract_all(c, F.lit(r"(->[A-Za-z_]\w*|\[[^\[\]]*\])"), F.lit(1))
    chains = F.transform(F.regexp_extract_all("code", F.lit(chain), F.lit(1)), normal_expression)
    long = F.filter(chains, lambda c: (F.size(links(c)) >= 2) & ((F.size(links(c)) > 3) | c.contains("[")) & ~root(c).isin(*SKIPPED))
    inner = F.flatten(F.transform(long, lambda c: F.transform(F.sequence(F.lit(1), F.size(links(c)) - 1), lambda k: F.concat(root(c), F.array_join(F.slice(links(c), F.lit(1), k), "")))))
    rows = rows.withColumn("inner", inner).filter(F.size("inner") > 0).withColumn("checked", checked_chains(F.col("code")))
    rows = rows.withColumn("expression", F.get(F.filter(F.array_except("inner", "checked"), lambda e: e.contains("->")), F.lit(0))).filter("expression is not null")
    pattern = F.replace(F.replace(escape_regex(F.col("expression")), F.lit(r"\->"), F.lit(r"[ \t]*->[ \t]*")), F.lit(r"\["), F.lit(r"[ \t]*\["))
    line = line_of_match(F.col("code"), pattern, F.col("start_line"))
    return rows.select(*candidate(F.col("file_path"), line, F.col("name"), "chain_npd", F.col("expression"), F.concat(F.lit("May "), F.col("expression"), F.lit(" be null?"))))


#: What names of sensitive data hold.
SENSITIVE_TERMS = (
    "accesskey accesssecret accesstoken aes apikey appkey appsecret auth bearer cert certificate chacha cipher cookie cred credential crypt crypto decrypt derivedkey des digest drbg dsa ecdh ecdsa ed25519 encrypt entropy hash "
    "handshake hkdf hmac jwt kdf key keybag keychain keyfile keyid keymaterial keyring keystore kms mac masterkey md5 mfa nonce otp pass passcode passphrase passwd password pbkdf pem pin pkcs pkey poly1305 premaster private "
    "privatekey privkey psk pwd random refresh refreshtoken rng rsa salt secret seed session sessionid sha sharedkey signature signingkey skey ssl ticket tls token totp trafficsecret vault x509"
).split()


def sensitive_clear(functions: DataFrame, terms: list[str] = SENSITIVE_TERMS) -> DataFrame:
    """Declared variables and parameters whose name or declaration holds a sensitive term, one row a function."""
    functions = functions.withColumn("code", once(blank_comments("body")))
    declaration = r"(?m)((?:[A-Za-z_]\w*[ \t*]+)+\**[A-Za-z_]\w*[ \t]*(?:\[[^\]]*\])?)[ \t]*(?=[;,=)])"
    found = lines_of(functions).select("*", F.explode(F.regexp_extract_all("text", F.lit(declaration), F.lit(1))).alias("declaration"))
    found = found.withColumn("variable", F.regexp_extract("declaration", r"([A-Za-z_]\w*)[ \t]*(?:\[[^\]]*\])?$", 1)).filter(~F.trim("declaration").rlike(r"^(return|goto|else|case)\b"))
    found = found.withColumn("terms", terms_in(F.concat_ws(" ", "variable", "declaration"), terms)).filter(F.size("terms") > 0)
    found = found.dropDuplicates(["function_id", "variable", "line"])
    entry = F.struct("line", "variable", F.array_join("terms", ",").alias("terms"))
    grouped = found.groupBy("function_id", "file_path", "name", "start_line").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    listed = F.array_join(F.transform("found", lambda x: F.concat(x["variable"], F.lit(":"), x["line"].cast("string"))), ", ")
    return grouped.select(*candidate(F.col("file_path"), F.col("found")[0]["line"], F.col("name"), "sensitive_clear", listed, F.concat(F.lit("Are these cleared after use: "), listed, F.lit("?"))))


#: What acquires, what releases, and what is held.
LOCKS = (
    (r"\bpthread_mutex_lock\s*\(", r"\bpthread_mutex_unlock\b", "mutex_lock"),
    (r"\bpthread_mutex_trylock\s*\(", r"\bpthread_mutex_unlock\b", "mutex_trylock"),
    (r"\bpthread_rwlock_rdlock\s*\(", r"\bpthread_rwlock_unlock\b", "rdlock"),
    (r"\bpthread_rwlock_wrlock\s*\(", r"\bpthread_rwlock_unlock\b", "wrlock"),
    (r"\bsem_wait\s*\(", r"\bsem_post\b", "sem_wait"),
    (r"\bsem_timedwait\s*\(", r"\bsem_post\b", "sem_timedwait"),
    (r"\bpthread_create\s*\(", r"\bpthread_(?:join|detach)\b", "thread"),
)


def lock_leaks(functions: DataFrame, least_returns: int = 2) -> DataFrame:
    """Functions with several returns that acquire a lock; what is never released is marked."""
    body = F.col("body")
    held = [F.when(body.rlike(a), F.concat(F.lit(name), F.when(body.rlike(r), "").otherwise(" (never released)"))) for a, r, name in LOCKS]
    found = functions.filter(F.regexp_count("body", F.lit(r"\breturn\b")) >= least_returns).withColumn("held", F.array_distinct(F.array_compact(F.array(*held)))).filter(F.size("held") > 0)
    what = F.array_join("held", ", ")
    return found.select(*candidate(F.col("file_path"), F.col("start_line"), F.col("name"), "resleak", what, F.concat(F.lit("Is every path releasing: "), what, F.lit("?"))))


#: What external checkers report as a leak, and names that do not allocate.
LEAK_IDS = ("memleak", "memleakOnRealloc", "resourceLeak", "leakReturnValNotUsed", "leakNoVarFunctionCall")
NOT_ALLOCATING = r"(?i)free|destroy|release|cleanup|check|verify|print|dump|is_|has_|get_count|get_size"


def external_leaks(errors: DataFrame, ids=LEAK_IDS) -> DataFrame:
    """Leaks of an external checker's ``errors(id, severity, file, line, function, message)``, one a file and function."""
    return keep_first(errors.filter(F.col("id").isin(*ids)), ["file", "function"], ["line"])


def resource_leaks(errors: DataFrame, functions: DataFrame) -> DataFrame:
    """``resleak``: leaks that an external checker reports, then functions that acquire a lock; of one file and function the
    first stays.

    errors(id, severity, file, line, message[, function]): an error without a function gets the innermost that holds its
    line, else ``<unknown>``.
    """
    rows = errors.filter(F.col("id").isin(*LEAK_IDS)).withColumn("request_id", F.concat_ws("\0", "file", F.col("line").cast("string")))
    located = containing_function(rows.select("request_id", F.col("file").alias("path"), "line").distinct(), functions, by_suffix=True)
    rows = rows.join(located.select("request_id", F.col("name").alias("_held")), "request_id", "left")
    given = F.col("function") if "function" in errors.columns else F.lit(None).cast("string")
    rows = rows.withColumn("function", F.coalesce(F.nullif(F.trim(given), F.lit("")), "_held", F.lit("<unknown>")))
    external = external_leaks(rows.select("id", "severity", "file", "line", "function", "message"))
    external = external.select(*candidate(F.col("file"), F.col("line"), F.col("function"), "resleak", F.col("id"), F.coalesce("message", F.lit(""))))
    locks = lock_leaks(functions).join(external.select("file", "function"), ["file", "function"], "left_anti").select(*external.columns)
    return external.unionByName(keep_first(locks, ["file", "function"], ["line"]))


def wrapper_allocators(functions: DataFrame, allocators: list[str], releasers: list[str]) -> DataFrame:
    """Names of functions that call an allocator, without those whose name says otherwise."""
    calls = F.arrays_overlap(call_names(F.col("body")), F.array(*map(F.lit, allocators)))
    return functions.filter(calls & ~F.col("name").rlike(NOT_ALLOCATING) & ~F.col("name").isin(*allocators, *releasers)).select("name").distinct()


def memory_api_candidates(functions: DataFrame) -> DataFrame:
    """Functions whose name or calls look like allocation or release, with role and evidence (at most 12 calls)."""
    from ..functions.text import ALLOC_CALL, ALLOC_NAME, FREE_CALL, FREE_NAME

    body = F.coalesce(F.col("body"), F.lit(""))
    found = functions.filter(F.col("name").rlike(f"{ALLOC_NAME}|{FREE_NAME}") | body.rlike(f"{ALLOC_CALL}|{FREE_CALL}"))
    calls = F.slice(F.array_sort(F.array_distinct(F.filter(call_names(body), lambda c: c.rlike(f"{ALLOC_NAME}|{FREE_NAME}")))), 1, 12)
    evidence = F.concat_ws("; ", F.when(F.col("name").rlike(ALLOC_NAME), "name looks like allocation"), F.when(F.col("name").rlike(FREE_NAME), "name looks like release"), F.when(F.size(calls) > 0, F.concat(F.lit("calls: "), F.array_join(calls, ", "))))
    ident = F.concat(F.lit("memapi-"), stable_id(F.lit("function"), F.col("name"), F.col("file_path"), F.col("start_line").cast("string"), length=16))
    return found.select(ident.alias("candidate_id"), "name", F.lit("function").alias("kind"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), role_hint(F.col("name"), F.col("body")).alias("role_hint"), evidence.alias("evidence"))


def name_pairs(allocators: DataFrame, releasers: DataFrame) -> DataFrame:
    """``(alloc_name, free_name)`` whose names are equal without their role words; of releasers the last one."""
    free = releasers.select(F.col("name").alias("free_name"), pair_name(F.col("name"), "free").alias("_k"), "seq")
    free = keep_first(free, ["_k"], [F.desc("seq")]).drop("seq")
    return allocators.select(F.col("name").alias("alloc_name"), pair_name(F.col("name"), "alloc").alias("_k")).join(free, "_k").drop("_k").distinct()


#: How a message names its function.
QUOTED, NAMED_ZH = r"Function=`([^`]+)`", r"函数\s+([A-Za-z_][A-Za-z0-9_:]*)\s+中"
NAMED, EITHER = r"Function\s+([A-Za-z_][A-Za-z0-9_:]*)", r"(?:函数\s+|Function(?:\s*=\s*|\s+))`?([A-Za-z_][A-Za-z0-9_:]*)`?"
ASSIGNED = r"Function\s*=\s*`([A-Za-z_][A-Za-z0-9_:]*)`"

#: For each detector that reads matches: where its function's name comes from, in order (a metavariable, a pattern over the
#: message, or the index), and what tells its matches apart.
MATCH_DETECTORS = {
    "intoverflow": (("index",), ("file", "line", "rule", "arith", "sink")),
    "safe_mem_oob": (("$FUNC", QUOTED), ("file", "line", "rule", "dst", "dst_size")),
    "loop_mut_idx_oob": (("index",), ("file", "line", "rule", "idx", "memory")),
    "bufoverflow": (("$FUNC", NAMED_ZH, "index"), ("file", "function", "rule", "type", "ptr", "field")),
    "double_free": (("$FUNC", NAMED, "index"), ("file", "function", "rule", "type", "resource", "release")),
    "inf_loop": (("$F", QUOTED, "index"), ("file", "function", "rule")),
    "mp_npd": ((EITHER, "index"), ("file", "function", "rule", "expr", "root")),
    "mp_resouce_leak": (("$FUNC", EITHER, "index"), ("file", "function", "rule", "field", "acquire")),
    "npd_funcret": (("$FUNC", ASSIGNED, "index"), ("file", "function", "callee", "ptr")),
}
#: What the parts of a key are made of: the first metavariable that has a value.
CAPTURED = {
    "dst": ("DST", "BUF", "ARR", "OBJ", "P", "PTR"), "dst_size": ("DSTSZ", "SZ"), "idx": ("IDX",), "type": ("CLASS", "TYPE"), "ptr": ("P",), "field": ("FIELD", "LENFIELD", "PAYLOAD"), "resource": ("P", "OBJ", "FIELD", "SP1", "OWNER"),
    "release": ("REL1", "REL2", "REL", "PUT1", "PUT2", "ALLOC"), "expr": ("EXPR", "P", "PTR"), "root": ("ROOT",), "acquire": ("ACQ", "ACQ1", "REALLOC", "TMP"), "callee": ("CALL",),
}


def function_name(value: Column) -> Column:
    """A name that says something: not blank, not ``unknown``, not a metavariable that was left open."""
    value = F.trim(value)
    return F.when((value != "") & (value != "unknown") & ~value.startswith("$"), value)


def from_matches(matches: DataFrame, functions: DataFrame, detector: str, null_returners: DataFrame | None = None) -> DataFrame:
    """Candidates of ``matches(match_id, path, line, check_id, message, metavars map[, metadata map])``: each gets its
    function in the order of its detector (the innermost of the index that holds the line, where it asks the index), and of
    equal ones the first stays.

    null_returners(name, can_return_null): for ``npd_funcret``, matches of a return value whose callee cannot return null
    are left out; a callee that it does not know may.
    """
    order, key = MATCH_DETECTORS[detector]
    rows, values = matches, Values()
    if "index" in order:
        # Each place is looked up once, however many matches are there; no function holds what is left out. With the same
        # filters wherever they are read, places are found by one shuffle.
        at = matches.filter("path IS NOT NULL AND line >= 0").groupBy("path", "line").agg(F.count(F.lit(1)).alias("_n"))
        total, n = (x or 0 for x in at.agg(F.sum("_n"), F.count(F.lit(1))).first())
        places = at.select("path", "line").withColumn("request_id", F.concat_ws("\0", "path", F.col("line").cast("string")))
        located = containing_function(places, functions, by_suffix=True, total=n).select("path", "line", F.col("name").alias("_indexed"))
        # Of few places the matches stay where they are, and are read once.
        rows = matches.join(F.broadcast(located), ["path", "line"], "left") if n <= FEW_FACTS else join_fact(matches, located, ["path", "line"], total)
    source = lambda o: F.col("_indexed") if o == "index" else F.col("metavars")[o] if o.startswith("$") else F.regexp_extract(F.coalesce("message", F.lit("")), o, 1)
    function = F.coalesce(*[function_name(source(o)) for o in order], F.lit("unknown"))
    rule = F.coalesce(F.nullif(F.substring_index("check_id", ".", -1), F.lit("")), F.lit("unknown"))
    if "metadata" in matches.columns:
        rule = F.coalesce(F.nullif(F.trim(F.col("metadata")["source_kind"]), F.lit("")), rule) if detector in ("intoverflow", "loop_mut_idx_oob") else rule
    made = {"arith": lambda: arithmetic(F.col("rule"), values), "sink": lambda: sink(values), "memory": lambda: memory_place(values)}
    parts = [k for k in key if k not in ("file", "line", "function", "rule")]
    shown = {k: F.coalesce(made[k]() if k in made else F.coalesce(*[metavar(v, values) for v in CAPTURED[k]]), F.lit("")) for k in parts}
    rows = rows.withColumns({"file": F.col("path"), "rule": rule, "function": function, **values.taken()}).withColumns(shown)
    if detector == "npd_funcret" and null_returners is not None:
        never = null_returners.filter(~F.col("can_return_null")).select(F.col("name").alias("callee"))
        returned = ~F.col("check_id").contains("param-assign")
        rows = rows.filter(~returned).unionByName(rows.filter(returned).join(never, "callee", "left_anti"))
    first = keep_first(rows, key, ["match_id"])
    subject = F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in parts], F.col("rule"))
    return first.select(*candidate(F.col("file"), F.greatest(F.lit(1), F.col("line")), F.col("function"), detector, subject, F.coalesce("message", F.lit("")), rule=F.col("rule"), **{k: F.col(k) for k in parts}))


def released_structs(functions: DataFrame, structs: DataFrame, release: str = r"free|release|destroy|clean_?up|dispose|unref|deinit|fini|delete|put_") -> DataFrame:
    """Calls that release a variable whose struct has two or more pointer members (``multi_ptr_leak2``).

    structs(name, definition): typedef aliases map to the struct defined first under that name.
    """
    hinted = functions.filter(F.lower("body").rlike(release)).withColumn("code", once(blank_comments("body")))
    call = lines_of(hinted).select("*", F.explode(F.regexp_extract_all("text", F.lit(rf"(?i)\b(\w*(?:{release})\w*\s*\(\s*[A-Za-z_]\w*\s*\))"), F.lit(1))).alias("call"))
    call = call.withColumns({"callee": F.regexp_extract("call", r"^(\w+)", 1), "argument": F.regexp_extract("call", r"\(\s*(\w+)\s*\)$", 1)})
    # The argument's declared type, from the code before: struct name or alias, as a pointer.
    declared = F.regexp_extract_all("code", F.lit(r"((?:struct\s+)?[A-Za-z_]\w*\s*\*+\s*[A-Za-z_]\w*)\s*[,;=)]"), F.lit(1))
    types = hinted.select("function_id", F.explode(declared).alias("d")).select("function_id", F.regexp_extract("d", r"(\w+)\s*\*", 1).alias("type"), F.regexp_extract("d", r"(\w+)$", 1).alias("argument")).distinct()
    members = F.size(F.regexp_extract_all("definition", F.lit(r"(\*\s*\w+\s*;)"), F.lit(1)))
    alias = F.explode(F.array_distinct(F.array_compact(F.array(short_name(F.col("name")), F.nullif(F.regexp_extract("definition", r"\}\s*\*?\s*(\w+)\s*;", 1), F.lit(""))))))
    owners = keep_first(structs.withColumn("members", members).select(alias.alias("type"), "members", F.col("struct_id")), ["type"], ["struct_id"]).filter("members >= 2").select("type", "members")
    found = call.join(types, ["function_id", "argument"]).join(owners, "type").dropDuplicates(["file_path", "line", "name", "callee", "argument"])
    return found.select(*candidate(F.col("file_path"), F.col("line"), F.col("name"), "multi_ptr_leak2", F.col("argument"), F.concat(F.lit("Does "), F.col("callee"), F.lit(" release all pointer members of "), F.col("type"), F.lit("?")), callee=F.col("callee"), members=F.col("members")))


def leak_issues(issues: DataFrame) -> DataFrame:
    """``issues(file, function, start_line, line, release, details)`` as one row a function: first line, sorted distinct
    releasing functions, and numbered details in order of line."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "details")))
    text = F.array_join(F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["details"])), "\n")
    return issues.groupBy("file", "function", "start_line").agg(F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set("release")), ", ").alias("releases"), text.alias("text"))


def runs_per_checker(candidates: DataFrame) -> DataFrame:
    """Candidates a checker found, before duplicates are dropped."""
    return candidates.groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n"))



"""Rules by suffix, states, placeholders and numbers, and the scan of all, on files of many suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import language_rules as L
from weftwork.operators.rule_pack import pack
from weftwork.plans.registry import query
from weftwork.plans.slots import expected, slot_files, slot_keys

_LINES = {
    "go": [["fmt.Println(x)", "log.Println(x)", "go fmt.Print(panic (1))"], ["var m map[string]int", "var m = make(map[string]int)", "m := map[string]int{}"], ["m = make(map[string]int)", "n, _ := f(1)"], "m[\"k\"] = 1"],
    "ts": [["let a: any = 1;", "many = 2;"], ["if (a == b) {}", "if (a === b) {}", "if (a !== b) {}"], ["setTimeout('x', 1)", "setTimeout(f, 1)"]],
    "jsx": ["<p dangerouslySetInnerHTML={x} />", ["eval(x)", "medieval(x)"]],
    "js": [["e.innerHTML = x", "e.textContent = x"], ["var q = 1", "let q = 1", "parseInt(q)"], ["width: 1280", "color: '#ff00aa'", "const n = 86400;"]],
    "cc": [["std::cout << x;", "goto end;", "strcpy(a, b);"], ["int *p = NULL;", "int p = 0;", "char_ptr = 0;"], ["x = *p;", "p->next();", "char_ptr->x();"], ["buf = realloc(buf, 2);", "gets(b);"]],
    "h": ["printf (1);", ["int *q = 0;", "q->x = 1;"], "q->y = 2;"],
    "bash": [["eval \"$x\"", "rm -rf /", "rm -rf /tmp/x"], ["curl http://x | sudo bash", "curl http://x > y"], "# placeholder 5000"],
    "lua": [["os.execute(x)", "os.exit(x)"], "-- 待办 4096", ["n = 4096", "N = 4096", "placeholder = 12"]],
    "swift": [["x = y!.z", "x = y as! Z", "try! f()", "x != y"]],
    "dart": [["a!.b", "x as Y)", "dynamic d", "ab ! c"]],
    "kt": [["x!!", "y as Z", "z as? Z"]],
    "php": [["echo $x", "$_GET['a']", "mysql_query($q)"], ["$a == 1", "$a === 1"]],
    "rb": [["puts x", "system('x')", "eval(x)"]],
    "ps1": [["Write-Host x", "Invoke-Expression $x", "Remove-Item a -Recurse"]],
    "cs": [["throw new Exception(1)", "(int)x", "async void F()", "Debug.Log(x)"]],
    "java": [["if (s == \"a\")", "s.equals(t)", "e.printStackTrace ()", "Class.forName(x)"]],
    "gd": [["get_node(\"a\").b", "queue_free()", "free()"], "var size = 1500"],
    "py": [["os.system(x)", "y = 0"], "limit = 3000", ["LIMIT = 3000", "VERSION 4000"], ["pickle.loads(data)", "# your_name: TODO: x"]],
    "txt": ["eval(x) placeholder", "example.com 5000 lorem   ipsum"],
}
_LANGUAGE = [
    ("go", "q % 3 = 0", 1, "debug_residue", "warning"), ("go", "q % 3 = 2", 1, "panic", "warning"), ("go", "q % 2 = 1", 3, "err_ignored", "warning"), ("go", "q % 3 = 0 AND q % 2 = 1", 4, "nil_map_write", "error"),
    ("ts", "q % 2 = 0", 1, "any_abuse", "info"), ("ts", "q % 3 = 0", 2, "loose_eq", "warning"), ("ts", "q % 2 = 0", 3, "string_exec", "warning"), ("jsx", "true", 1, "xss_risk", "warning"), ("jsx", "q % 2 = 0", 2, "dynamic_exec", "error"),
    ("js", "q % 2 = 0", 1, "xss_risk", "warning"), ("js", "q % 3 = 0", 2, "var_leak", "info"), ("js", "q % 3 = 2", 2, "parseint_radix", "warning"),
    ("cc", "q % 3 = 0", 1, "debug_residue", "warning"), ("cc", "q % 3 = 1", 1, "goto_used", "warning"), ("cc", "q % 3 = 2", 1, "unsafe_string", "warning"), ("cc", "q % 3 = 0", 3, "null_deref", "error"), ("cc", "q % 3 = 2", 3, "null_deref", "error"),
    ("cc", "q % 2 = 0", 4, "realloc_unchecked", "warning"), ("cc", "q % 2 = 1", 4, "gets_unsafe", "error"), ("h", "true", 1, "debug_residue", "warning"),
    ("bash", "q % 3 = 0", 1, "shell_injection", "error"), ("bash", "q % 3 = 1", 1, "destructive", "error"), ("bash", "q % 2 = 0", 2, "pipe_exec", "warning"), ("lua", "q % 2 = 0", 1, "shell_injection", "error"),
    ("swift", "q % 4 = 0", 1, "force_unwrap", "warning"), ("swift", "q % 4 = 1", 1, "force_cast", "warning"), ("swift", "q % 4 = 2", 1, "force_try", "warning"), ("swift", "q % 4 = 3", 1, "force_unwrap", "warning"),
    ("dart", "q % 4 = 0", 1, "nonnull_assert", "warning"), ("dart", "q % 4 = 1", 1, "unsafe_cast", "warning"), ("dart", "q % 4 = 2", 1, "dynamic_abuse", "info"), ("kt", "q % 3 = 0", 1, "nonnull_assert", "warning"), ("kt", "q % 3 = 1", 1, "unsafe_cast", "warning"),
    ("php", "q % 3 = 0", 1, "debug_residue", "warning"), ("php", "q % 3 = 1", 1, "unsanitized_input", "warning"), ("php", "q % 3 = 2", 1, "unsafe_sql", "warning"), ("php", "q % 2 = 0", 2, "loose_eq", "warning"),
    ("rb", "q % 3 = 0", 1, "debug_residue", "warning"), ("rb", "q % 3 = 1", 1, "shell_injection", "warning"), ("rb", "q % 3 = 2", 1, "dynamic_exec", "error"),
    ("ps1", "q % 3 = 0", 1, "debug_residue", "warning"), ("ps1", "q % 3 = 1", 1, "shell_injection", "error"), ("ps1", "q % 3 = 2", 1, "destructive", "warning"),
    ("cs", "q % 4 = 0", 1, "bare_throw", "warning"), ("cs", "q % 4 = 1", 1, "unsafe_cast", "warning"), ("cs", "q % 4 = 2", 1, "async_void", "warning"), ("cs", "q % 4 = 3", 1, "debug_residue", "warning"),
    ("java", "q % 4 = 0", 1, "string_equals", "warning"), ("java", "q % 4 = 1", 1, "equals_npe", "warning"), ("java", "q % 4 = 2", 1, "debug_residue", "warning"), ("java", "q % 4 = 3", 1, "dynamic_load", "warning"),
    ("gd", "q % 3 = 0", 1, "null_access", "warning"), ("gd", "q % 3 = 2", 1, "free_unsafe", "warning"),
]
_SCANNED = [*_LANGUAGE, ("py", "q % 2 = 0", 1, "shell_injection", "critical"), ("py", "q % 2 = 0 AND true", 4, "unsafe_pickle", "critical"), ("py", "q % 2 = 0", 4, "py_pickle_untrusted", "error"), ("js", "q % 2 = 0", 1, "js_innerhtml_untrusted", "warning")]
_TEXT = [
    ("js", "q % 3 = 0", 3, "ui_hardcode", "", ("what", "width: 1280")), ("js", "q % 3 = 1", 3, "ui_hardcode", "", ("what", "#ff00aa")), ("js", "q % 3 = 0", 3, "magic_number", "", ("what", "1280")), ("js", "q % 3 = 2", 3, "magic_number", "", ("what", "86400")),
    ("lua", "q % 3 = 0", 3, "magic_number", "", ("what", "4096")), ("lua", "q % 3 = 2", 3, "text_placeholder", "", ("what", "placeholder")), ("gd", "true", 2, "magic_number", "", ("what", "1500")),
    ("py", "true", 2, "magic_number", "", ("what", "3000")), ("txt", "true", 1, "text_placeholder", "", ("what", "placeholder")), ("txt", "true", 2, "text_placeholder", "", ("what", "example.com")), ("txt", "true", 2, "text_placeholder", "", ("what", "lorem   ipsum")),
]


@query("language_rules", f"WITH {slot_keys(_LINES)} {expected(_LANGUAGE)}")
def language_rules(spark, sf_dir):
    return L.language_findings(slot_files(spark, sf_dir, _LINES)).select("file", "line", "rule", "severity")


@query("bug_scan", f"WITH {slot_keys(_LINES)}, f AS ({expected(_SCANNED)}) SELECT rule, severity, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY ALL")
def bug_scan(spark, sf_dir):
    files = slot_files(spark, sf_dir, _LINES)
    syntax = files.where("path LIKE '%.py'").select("path", F.regexp_replace("text", "VERSION 4000", "VERSION = 4000").alias("text"))
    found = L.scan(files.where("path NOT LIKE '%.py'").unionByName(syntax), pack(spark))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query("text_rules", f"WITH {slot_keys(_LINES)} SELECT file, line, rule, what FROM ({expected(_TEXT)})")
def text_rules(spark, sf_dir):
    return L.text_rules(slot_files(spark, sf_dir, _LINES))


@query("todo_counts", f"WITH {slot_keys(_LINES)} SELECT file, CAST(CASE WHEN lang = 'py' AND q % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM k")
def todo_counts(spark, sf_dir):
    return L.todo_counts(slot_files(spark, sf_dir, _LINES))

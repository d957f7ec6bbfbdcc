"""Program reader, interpreter, scan, sources and streams on small fixtures."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import taint_models as M
from factloom.operators.taint_interpreter import Interpreter, truth
from factloom.operators.taint_scan import callables_of, scan
from factloom.plans.scan_queries import excerpt_callables, excerpt_findings
from factloom.sources.excerpts import as_program, program_excerpts
from factloom.sources.php_parser import PhpError, parse_php
from factloom.sources.readers import archive_files, directory_plugins, job_markdown, payload_findings, payload_summaries, program_files, read_payloads, write_findings
from factloom.streaming.jobs import STATES, job_states, latest_states, next_state, read_upserted, upsert, windowed_counts, write_events


def flows(code, key="file:a.php", summaries=None, strict=False):
    record = next(c for c in callables_of("a.php", "<?php " + code) if c["key"] == key)
    return Interpreter(record, summaries or {}, strict).run()


def rules(code, **more):
    return sorted({s[0] for s in flows(code, **more)["sinks"] if s[2][0] == "S"})


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("echo $_GET['a'];", [M.REFLECTED]),
        ("echo esc_html($_GET['a']);", []),
        ("echo html_entity_decode(esc_html($_GET['a']));", []),
        ("echo (int) $_GET['a'];", []),
        ("$x = $_GET; echo $x['k'];", [M.REFLECTED]),
        ("$x = ['a' => 1, 'b' => $_GET['q']]; echo $x['a'];", []),
        ("$x = ['a' => 1, 'b' => $_GET['q']]; echo $x['b'];", [M.REFLECTED]),
        ("$x = $_GET['q']; $x = 'safe'; echo $x;", []),
        ("if ($c) { $x = $_GET['q']; } else { $x = 1; } echo $x;", [M.REFLECTED]),
        ("if ($c) { $x = $_GET['q']; return; } echo $x;", []),
        ("if (false) { echo $_GET['q']; }", []),
        ("echo isset($_GET['q']) ? 'y' : 'n';", []),
        ("echo $_GET['q'] ?: 'n';", [M.REFLECTED]),
        ("echo \"a {$_GET['q']} b\";", [M.REFLECTED]),
        ("echo get_option('x');", [M.STORED]),
        ("echo esc_attr(get_option('x'));", []),
        ("echo html_entity_decode(esc_attr(get_option('x')));", [M.STORED]),
        ("include $_GET['f'];", [M.INCLUDE]),
        ("include basename($_GET['f']);", []),
        ("unlink($_POST['f']);", [M.PATH]),
        ("move_uploaded_file($_FILES['f']['tmp_name'], $d);", [M.UPLOAD]),
        ("global $wpdb; $wpdb->query(\"x $_GET[q]\");", [M.SQL]),
        ("global $wpdb; $wpdb->query($wpdb->prepare('x %s', $_GET['q']));", []),
        ("global $wpdb; $wpdb->query('x ' . absint($_GET['q']));", []),
        ("mysqli_query($c, $_GET['q']);", [M.SQL]),
        ("update_option('k', $_POST['v']);", [M.ACTION]),
        ("eval($_GET['c']);", [M.USE]),
        ("system($_GET['c']);", [M.USE]),
        ("$f = $_GET['f']; $f();", [M.USE]),
        ("unserialize($_COOKIE['c']);", [M.OBJECT]),
        ("unserialize($_COOKIE['c'], ['allowed_classes' => false]);", []),
        ("$u->set_role($_POST['r']);", [M.PRIVILEGE]),
        ("$u->set_role('subscriber');", []),
        ("wp_redirect($_GET['u']);", [M.REDIRECT]),
        ("header('X: ' . $_GET['u']);", [M.HEADER]),
        ("foreach ($_GET as $k => $v) { echo $v; }", [M.REFLECTED]),
        ("switch ($a) { case 1: echo $_GET['q']; break; default: exit; }", [M.REFLECTED]),
        ("try { f(); } catch (E $e) { echo $_GET['q']; }", [M.REFLECTED]),
        ("list($a, $b) = [1, $_GET['q']]; echo $a;", []),
        ("echo $_SERVER['HTTP_REFERER'];", [M.REFLECTED]),
        ("echo $_SERVER['SERVER_PORT'];", []),
        ("defined('X') || exit; echo $_GET['q'];", [M.REFLECTED]),
        ("$a or die(); echo $_GET['q'];", [M.REFLECTED]),
        ("exit; echo $_GET['q'];", []),
    ],
)
def test_one_flow(code, want):
    assert rules(code) == want


def test_strict_profile_sees_the_second_turn():
    code = "while ($c) { echo $x; $x = $_GET['q']; }"
    assert rules(code) == [] and rules(code, strict=True) == [M.REFLECTED]


def test_three_valued_truth():
    def value(code):
        return truth(parse_php(f"<?php {code};")[0][2])

    assert value("true && false") is False and value("$x && false") is False and value("$x || true") is True
    assert value("$x && true") is None and value("!'0'") is True and value("null") is False


def test_unreadable_program():
    with pytest.raises(PhpError):
        parse_php("<?php function ( {")
    with pytest.raises(PhpError):
        parse_php("<?php echo " + "(" * 3000 + "1" + ")" * 3000 + ";")
    assert parse_php("") == [] and parse_php("plain <b>text</b>")[0][0] == "html"


PROGRAM = {
    "main.php": """<?php
class Child extends Base {
  function __construct() { add_action('wp_ajax_nopriv_go', array($this, 'go')); add_action('wp_ajax_safe', [$this, 'safe']); }
  function go() { $this->run($_POST['id']); do_action('show', $_GET['h']); }
  function safe() { if (!current_user_can('edit_pages')) { wp_die(); } update_option('k', $_POST['v']); }
}
function outer($q) { global $wpdb; return $wpdb->get_results("SELECT $q"); }
function on_show($v) { echo $v; }
add_action('show', 'on_show');
function helper() { return array('safe' => 'ok', 'danger' => $_GET['msg']); }
function render() { $value = helper(); echo $value['safe']; }
function loop_a($x) { loop_b($x); } function loop_b($x) { loop_a($x); echo $x; }
loop_a($_GET['z']);
""",
    "base.php": """<?php
class Base { protected function run($v) { outer($v); outer((int) $v); } }
register_rest_route('x/v1', '/y', array('callback' => 'rest_cb', 'permission_callback' => 'rest_ok'));
function rest_ok() { return current_user_can('manage_options'); }
function rest_cb($request) { update_option('a', $request->get_param('p')); include $request->get_param('p'); }
""",
    "broken.php": "<?php if (",
}


def _scan(spark, files):
    rows = [(r, p, s) for r, ps in files.items() for p, s in ps.items()]
    return scan(spark.createDataFrame(rows, "root string, path string, source string"))


def test_scan_of_programs(spark):
    out = _scan(spark, {"one": PROGRAM, "two": {"x.php": "<?php echo $_GET['a'];"}, "empty": {"n.php": None, "e.php": ""}}).cache()
    got = sorted((r.root, r.rule_id, r.callable, r.access) for r in out.collect())
    assert got == [
        ("one", M.INCLUDE, "f:rest_cb", "capability_checked"),
        ("one", M.SQL, "f:outer", "unauthenticated"),
        ("one", M.REFLECTED, "f:loop_b", "unknown"),
        ("one", M.REFLECTED, "f:on_show", "unauthenticated"),
        ("two", M.REFLECTED, "file:x.php", "unknown"),
    ]
    include = out.where(F.col("rule_id") == M.INCLUDE).first()
    assert (include.required_capability, include.minimum_role, include.severity) == ("manage_options", "administrator", "low")
    assert include.sink.path == "base.php" and include.source.line == 5


def test_stored_values_meet_their_writers(spark):
    files = {
        "s": {
            "w.php": "<?php defined('ABSPATH') || exit; add_action('wp_ajax_nopriv_w', 'w'); function w() { set_transient('k', $_POST['v']); set_transient('z', 1); }",
            "r.php": "<?php defined('ABSPATH') || exit; add_shortcode('r', 'r'); function r() { echo get_transient('k'); echo get_option('none'); }",
            "lib/inc.php": "<?php echo $_GET['a'];",
            "i.php": "<?php include __DIR__ . '/lib/inc.php';",
        }
    }
    got = {(r.rule_id, r.source.snippet[-20:], r.access, r.stored_access, r.score) for r in _scan(spark, files).collect() if r.rule_id == M.STORED}
    assert {x[2:] for x in got} == {("unauthenticated", "unauthenticated", 1000)}
    reflected = _scan(spark, files).where(F.col("rule_id") == M.REFLECTED).first()
    assert {tuple(e)[:2] for e in reflected.entrypoints} == {("file", "lib/inc.php"), ("file", "i.php")}


def test_scan_of_nothing(spark):
    files = spark.createDataFrame([], "root string, path string, source string")
    assert scan(files).count() == 0


def test_program_files_and_archives(spark, tmp_path):
    for name in ("p/a.php", "p/sub/b.php", "p/vendor/c.php", "p/readme.txt", "q/d.php"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<?php")
    got = {(r.root, r.path) for r in program_files(spark, str(tmp_path)).collect()}
    assert got == {("p", "a.php"), ("p", "sub/b.php"), ("q", "d.php")}
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        for name in ("a.php", "../evil.php", "/abs.php", "n.txt"):
            z.writestr(name, "<?php")
    archives = spark.createDataFrame([("g", bytearray(good.getvalue())), ("bad", bytearray(b"no zip")), ("none", None)], "root string, content binary")
    rows = {(r.root, r.path, r.error is None) for r in archive_files(archives).collect()}
    assert rows == {("g", "a.php", True), ("g", "../evil.php", False), ("g", "/abs.php", False), ("bad", None, False), ("none", None, False)}
    assert {r.error for r in archive_files(archives.where("root = 'g'"), max_bytes=3).collect()} == {"archive exceeds its limits"}


def test_payloads_and_directory(spark, tmp_path):
    payload = {"summary": {"elapsed_ms": 5}, "results": [{"check_id": "r", "path": "p", "start": {"line": 3}, "extra": {"message": "m", "context": {"access": "nonce_only"}}}], "errors": []}
    (tmp_path / "x.json").write_text(json.dumps(payload))
    f = payload_findings(read_payloads(spark, str(tmp_path / "x.json"))).drop("file")
    r = f.first()
    assert (r.rule_id, r.line, r.access, r.source) == ("r", 3, "nonce_only", None)
    write_findings(f, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    body = json.dumps({"plugins": [{"slug": "a", "requires_php": False, "icons": False, "rating": 90}, {"slug": "b", "requires_php": 7.4, "icons": {"1x": "u"}}]})
    pages = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    got = [(r.slug, r.requires_php, r.icons, r.rating) for r in directory_plugins(pages).collect()]
    assert got == [("a", None, {}, 90), ("b", "7.4", {"1x": "u"}, None)]


def _events():
    rng = random.Random(12)
    rows = [(f"j{rng.randrange(8)}", i, rng.choice([*STATES[:4], *STATES[:3], "failed", "odd", None])) for i in range(120)]
    return rows + [(None, 500, "done")]


def test_job_states_stream_equals_batch(spark, tmp_path):
    rows = _events()
    want = {}
    for job, _, status in rows:
        if job and (state := next_state(want.get(job), status)):
            want[job] = state
    schema = "job_id string, seq int, status string"
    batch = spark.createDataFrame(rows, schema)
    assert {r.job_id: r.status for r in latest_states(batch).collect()} == want
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40 + (k == 2)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "states")
    states = job_states(stream)
    query = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(upsert(target, "job_id", "n_events")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {r.job_id: r.status for r in read_upserted(spark, target, "job_id", "n_events").collect()}
    assert got == want


def test_windows_drop_late_events_only_when_streaming(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 05:00:00", "b")]
    df = spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    got = sorted((r.k, r.n) for r in windowed_counts(df, "t", ["k"], "1 hour", "10 minutes").collect())
    assert got == [("a", 2), ("b", 1)]


CODE = "function f() {\n    update_option( 'k', $_POST['v'] );\n}"


@pytest.mark.parametrize(
    "text",
    [
        f"Hello.\n\n{CODE}\n\nOnly a role (of the site) may call it; see below.",
        f"Hello.\r\n{CODE}\r\n* a list\r\n".replace("\r\n", "\n").replace("\n", "\r\n"),
        "Hello.\n\n" + "\n".join("    " + x for x in CODE.split("\n")) + "\n\nBye.",
        f"Hello.\n```\n{CODE}\n```\nBye.",
        f"Hello.\n```php\n{CODE}\n```\nBye.",
        f"Hello. <pre><code>{CODE}</code></pre> Bye.",
        f"Hello. <pre class='x'>{CODE}</pre> Bye.",
        "Hello. &lt;pre&gt;&lt;code&gt;" + CODE.replace("'", "&#039;") + "&lt;/code&gt;&lt;/pre&gt; Bye.",
        f"<p>Hello.</p>\n<p>{CODE}</p>\n<p>Bye.</p>",
        f"Hello.\n```php\n{CODE}\n\nA fence that stays open.",
    ],
)
def test_program_text_in_any_form(text):
    (got,) = program_excerpts(text)
    assert [x.strip() for x in got.split("\n")] == [x.strip() for x in CODE.split("\n")]
    assert [c["key"] for c in callables_of("a.php", as_program(got))][0] == "f:f"


def test_prose_is_no_program():
    assert program_excerpts("If (as often) it fails, call me.\nSee page (2); then return the book.\nUse it; for now.\n* get_item\n$5 is cheap") == []
    assert program_excerpts("```\nnpm install\n```\n    indented prose") == []
    assert program_excerpts("$a = 1;\ntext\n```php\n$b = 2;\n```\n$x = a( '-&gt;', $b-&gt;c );") == ["$a = 1;", "$b = 2;", "$x = a( '->', $b->c );"]


def test_excerpts_of_plain_text_are_scanned(spark, tmp_path):
    text = "Hello.\n\n$sql = \"SELECT $x\" . $_REQUEST['r'];\n$wpdb->query( $sql );\n\nBye."
    spark.createDataFrame([(1, text), (2, "no code"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.kind, r.n) for r in excerpt_callables(spark, str(tmp_path)).collect()] == [("file", 1)]
    assert [(r.rule_id, r.n, r.n_documents) for r in excerpt_findings(spark, str(tmp_path)).collect()] == [(M.SQL, 1, 1)]


def test_namespaces_tell_names_apart(spark):
    files = {
        "n": {
            "a.php": "<?php namespace App\\Front; use App\\Back\\{Page as Other, Tool}; use function App\\Back\\show as reveal;\n"
            "class Page { function run($v) { echo esc_html($v); } }\nfunction show($v) { echo esc_html($v); }\n"
            "function go() { show($_GET['a']); reveal($_GET['b']);\n\\show($_GET['c']); only($_GET['d']); (new Page())->run($_GET['e']); (new Other())->run($_GET['f']); namespace\\show($_GET['g']); }\n",
            "b.php": "<?php namespace App\\Back { class Page { function run($v) { echo $v; } }\nfunction show($v) { echo $v; } }",
            "c.php": "<?php function show($v) { echo $v; }\nfunction only($v) { echo $v; } add_action('wp_ajax_x', 'App\\Back\\late');",
            "d.php": "<?php if ($a) { function twice() { echo $_GET['p']; } } else { function twice() { echo $_GET['q']; } } $f = [fn() => 1, fn() => print($_GET['r'])];",
        }
    }
    out = _scan(spark, files).collect()
    assert sorted((r.path, r.callable, r.source.path) for r in out) == [
        ("b.php", "f:app\\back\\show", "a.php"),
        ("b.php", "m:app\\back\\page::run", "a.php"),
        ("c.php", "f:only", "a.php"),
        ("c.php", "f:show", "a.php"),
        ("d.php", "closure:d.php:1.2", "d.php"),
        ("d.php", "f:twice", "d.php"),
        ("d.php", "f:twice#2", "d.php"),
    ]


def test_names_of_parser():
    assert parse_php("<?php namespace A; f(); B\\f(); \\f(); __NAMESPACE__;")[1][2][2] == "A\\B\\f"
    keys = {c["key"]: c for c in callables_of("a.php", "<?php namespace A; use X\\P; class C extends P { function m(C $c, int $i, ?P $p) {} }")}
    record = keys["m:a\\c::m"]
    assert record["parent"] == "x\\p" and [p[1] for p in record["params"]] == ["A\\C", "int", "X\\P"]


def test_inherited_methods_of_long_chains_and_cycles(spark):
    chain = "".join(f"class C{i} extends C{i + 1} {{}} " for i in range(9))
    files = {
        "long": {"a.php": f"<?php {chain} (new C0())->show($_GET['a']); (new C0())->none($_GET['b']);", "b.php": "<?php class C9 { function show($v) { echo $v; } }"},
        "round": {"a.php": "<?php class A extends B {} class B extends A {} (new A())->show($_GET['a']);"},
    }
    assert [(r.root, r.callable, r.source.path) for r in _scan(spark, files).collect()] == [("long", "m:c9::show", "a.php")]


def test_scan_cases_with_and_without_what_cannot_matter(spark):
    from factloom.plans.scan_programs import EXPECTED, program_files as case_files

    want = sorted(tuple(line.split(" ")[:3]) for line in EXPECTED.strip().splitlines())
    out = scan(case_files(spark), prune=False).collect()
    assert sorted((r.root, r.rule_id, f"{r.path}:{r.line}") for r in out) == want


def test_query_text():
    from factloom.functions.sql_text import is_aggregate, read_tables, select_columns, table_key, write_columns

    assert select_columns("SELECT a.name, count(x) AS n, concat(b, ',', c) `z` FROM {}posts p") == [("name", "name"), ("count(x)", "n"), ("concat(b, ',', c)", "z")]
    assert read_tables("select 1 from {}posts p join `wp_users` u on 1 = 1") == ["posts", "users"]
    assert write_columns("INSERT INTO {}t (a, `b`) VALUES (1, 2)") == ("t", ["a", "b"])
    assert write_columns("update wp_t set a = 1, b = f(2, 3) where c = 1") == ("t", ["a", "b"])
    assert is_aggregate("select count(*) from t") and not is_aggregate("select count(*), a from t") and not is_aggregate(None)
    assert select_columns(None) == [] and read_tables("") == [] and write_columns("drop table t") is None and table_key(None) is None


def test_events_are_written_once(spark, tmp_path):
    schema = "job_id string, seq int, status string"
    for k, rows in enumerate(([("a", 1, "queued"), ("b", 2, "queued")], [("a", 3, "done"), ("a", 4, "queued"), (None, 5, "done")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_events(job_states(stream), str(tmp_path / "events"), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert query.exception() is None
    events = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "events")).collect()]
    assert sorted((e["type"], e["job"]["job_id"], e["job"]["status"]) for e in events) == [("job", "a", "done"), ("job", "a", "queued"), ("job", "b", "queued")]


def test_payload_summaries_and_reports(spark):
    f = spark.createDataFrame([("j", "r"), ("j", "r"), ("j", None), ("x", "q")], "job_id string, rule_id string")
    runs = spark.createDataFrame([("j", "2024", 5, 1), ("k", None, None, None)], "job_id string, generated_at string, elapsed_ms bigint, total_errors int")
    got = {r.job_id: (r.total_results, r.total_errors, r.results_per_rule) for r in payload_summaries(f, runs, "job_id").collect()}
    assert got == {"j": (3, 1, {"r": 2}), "k": (0, 0, {})}
    jobs = spark.createDataFrame([("j", "s 1"), ("k", None)], "id string, title string")
    counts = spark.createDataFrame([("j", "b", 1), ("j", "a", 2), ("j", None, 9)], "id string, name string, n int")
    text = {r.id: r.markdown for r in job_markdown(jobs, counts).collect()}
    assert text["j"].split("\n") == ["# s 1", "", "| Name | Count |", "|---|---|", "| a | 2 |", "| b | 1 |"] and text["k"].startswith("# \n")


def test_formats_that_take_no_text():
    assert rules("printf('%d', $_GET['q']);") == [] and rules("printf('%5$s', $_GET['q']);") == [M.REFLECTED] and rules("printf($f, $_GET['q']);") == [M.REFLECTED]


def test_calls_that_always_end_the_request(spark):
    code = "<?php function stop() { if ($a) { wp_die(); } else { exit; } } function maybe() { if ($a) { exit; } } function go() { maybe();\necho $_GET['a']; stop();\necho $_GET['b']; } go();"
    assert [r.line for r in _scan(spark, {"e": {"a.php": code}}).collect()] == [2]

"""Programs of a few lines, each a case of its own, with the findings and facts that a scan must give.

What is expected stands in the SQL beside them. It was drawn up with the output
of a run in view and each row gone over by the rules, so it guards against
change and is no proof by a second hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends a file that is requested by itself, so that it is no entry.
_SHUT = "<?php defined('ABSPATH') || exit;\n"

PROGRAMS: dict[str, dict[str, str]] = {
    # Capability and login checks count in conditions and returns only.
    "guard_bare": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { current_user_can('manage_options');\nupdate_option('k', $_POST['v']); }"},
    "guard_negated": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!current_user_can('manage_options')) { wp_die(); }\nupdate_option('k', $_POST['v']); }"},
    "guard_positive": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (current_user_can('edit_posts') && $x) {\nupdate_option('k', $_POST['v']); } }"},
    "guard_false": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (false === current_user_can('manage_options')) { return; }\nupdate_option('k', $_POST['v']); }"},
    "guard_variable": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { $ok = current_user_can('manage_options'); if (!$ok) { return; }\nupdate_option('k', $_POST['v']); }"},
    "guard_low": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!current_user_can('read')) { return; }\nupdate_option('k', $_POST['v']); }"},
    "guard_chosen": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { $c = $_POST['cap']; if (!current_user_can($_POST['cap'])) { return; }\nupdate_option('k', $_POST['v']); }"},
    "guard_login": {"a.php": _SHUT + "add_action('init', 'a');\nfunction a() { if (is_user_logged_in()) {\nupdate_option('k', $_POST['v']); } }"},
    "guard_nonce": {"a.php": _SHUT + "add_action('x_hook', 'a');\nfunction a() { check_ajax_referer('n');\nupdate_option('k', $_POST['v']); }"},
    "helper_statement": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { allow();\nupdate_option('k', $_POST['v']); }\nfunction allow() { if (!current_user_can('manage_options')) { wp_die(); } }"},
    "helper_no_end": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { allow();\nupdate_option('k', $_POST['v']); }\nfunction allow() { return current_user_can('manage_options'); }"},
    "helper_condition": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!allow()) { return; }\nupdate_option('k', $_POST['v']); }\nfunction allow() { return inner(); }\nfunction inner() { return current_user_can('manage_options'); }"},
    "helper_method": {"a.php": _SHUT + "class A { function __construct() { add_action('wp_ajax_a', [$this, 'a']); }\nfunction a() { $this->allow();\nupdate_option('k', $_POST['v']); }\nprivate function allow() { if (!current_user_can('manage_options')) { wp_send_json_error('no'); } } }"},
    # Tiers of entries.
    "tier_nopriv": {"a.php": _SHUT + "add_action('wp_ajax_nopriv_a', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_ajax": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_shortcode": {"a.php": _SHUT + "add_shortcode('a', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_admin_init": {"a.php": _SHUT + "add_action('admin_init', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_loaded": {"a.php": _SHUT + "add_action('plugins_loaded', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_rest_open": {"a.php": _SHUT + "register_rest_route('n/v1', 'r', ['callback' => 'a']);\nfunction a($r) { echo $r->get_param('q'); }"},
    "tier_rest_guard": {"a.php": _SHUT + "register_rest_route('n/v1', '/r', ['callback' => 'a', 'permission_callback' => 'ok']);\nfunction a($r) { echo $r->get_param('q'); }\nfunction ok() { return true; }"},
    "tier_page": {"a.php": _SHUT + "add_meta_box('id', 't', 'a');\nfunction a() { echo $_GET['q']; }"},
    "tier_file": {"a.php": "<?php\necho $_GET['q'];"},
    # Names.
    "name_space": {"a.php": _SHUT.replace("<?php", "<?php namespace A;") + "function f($v) { echo esc_html($v); } f($_GET['q']);", "b.php": _SHUT.replace("<?php", "<?php namespace B;") + "function f($v) {\necho $v; }\nf($_GET['q']);"},
    "name_closures": {"a.php": _SHUT + "add_action('wp_ajax_nopriv_a', function() { return 1; }); add_action('wp_ajax_nopriv_b', function() { echo $_GET['q']; });"},
    "name_chain": {"a.php": _SHUT + "class A extends B {} class B extends C {} class C extends D {} class D extends E {} class E extends F {} class F extends G {} class G extends H {}\nclass H { function show($v) {\necho $v; } }\n(new A())->show($_GET['q']);"},
    "name_trait": {"a.php": _SHUT + "trait Shows { function show($v) {\necho $v; } } class P { use Shows; } class C extends P { use Other; }\n(new C())->show($_GET['q']);"},
    "name_property": {"a.php": _SHUT + "class S { function show($v) {\necho $v; } } class T { function show($v) { return 1; } }\nclass A { function __construct() { $this->s = new S(); } function run() { $this->s->show($_GET['q']); } }"},
    "name_holes": {"a.php": _SHUT + "class A { function go() { $x = $_GET['x']; $this->{'do_' . $x}($_GET['q']); }\nfunction do_show($v) {\necho $v; } function other($v) { print $v; } }"},
    "name_hook_holes": {"a.php": _SHUT + "add_action('save_post', 'a'); do_action(\"save_{$t}\", $_GET['q']);\nfunction a($v) {\necho $v; }"},
    # Paths.
    "path_plain": {"a.php": _SHUT + "unlink($_GET['f']);"},
    "path_base": {"a.php": _SHUT + "unlink('/x/' . basename($_GET['f']));"},
    "path_real_abort": {"a.php": _SHUT + "$p = $_GET['f']; if (realpath($p) !== $p) { return; }\nunlink($p);"},
    "path_real_branch": {"a.php": _SHUT + "$p = $_GET['f']; if ($p === realpath($p)) { unlink($p); } else {\nunlink($p); }"},
    "path_inside": {"a.php": _SHUT + "$p = realpath($_GET['f']); if (file_exists($p) && strpos($p, '/var/data/') === 0) { readfile($p); }\nreadfile($p);"},
    "path_helper": {"a.php": _SHUT + "function clean($p) { if (strpos($p, '..') !== false || !file_exists($p)) { return ''; } return $p; }\nreadfile(clean($_GET['f'])); function loose($p) { return $p; }\nreadfile(loose($_GET['f']));"},
    "path_include": {"a.php": _SHUT + "include $_GET['f'];"},
    "delete_guarded": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!current_user_can('manage_options')) { return; }\nunlink($_POST['f']); }"},
    "delete_open": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() {\nunlink($_POST['f']); }"},
    "delete_both": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a'); add_menu_page('t', 't', 'c', 's', ['A', 'a']);\nclass A { static function a() { a(); } }\nfunction a() { if (!current_user_can('manage_options')) { return; } \n\n\n" + "$x = 1;\n" * 50 + "update_option('k', $_POST['f']); }"},
    # Values.
    "value_constant": {"a.php": _SHUT + "define('MODE', 'on'); if (MODE === 'off') { echo $_GET['q']; }\nif (MODE === 'on') {\necho $_GET['r']; }"},
    "value_class_constant": {"a.php": _SHUT + "class C { const A = 'x'; const B = self::A . 'y'; }\nadd_option(C::B, 'v'); if (C::B === 'xz') { echo $_GET['q']; }"},
    "value_switch": {"a.php": _SHUT + "switch ($m) { case 1: $v = $_GET['q']; break; default: $v = 'x'; }\necho $v;"},
    "value_kill": {"a.php": _SHUT + "$v['a'] = $_GET['q']; $v['a'] = 'x'; echo $v['a'];\n$v['b'] = $_GET['q']; echo $v['b'];"},
    "value_number": {"a.php": _SHUT + "echo (int) $_GET['a'], absint($_GET['b']);\necho $_GET['c'] . '';"},
    "value_undone": {"a.php": _SHUT + "echo esc_html($_GET['a']);\necho html_entity_decode(esc_html($_GET['b']));"},
    "value_extract": {"a.php": _SHUT + "extract(['q' => $_GET['q']]);\necho $q;"},
    "value_include": {"a.php": _SHUT + "include __DIR__ . '/inc/b.php';", "inc/b.php": _SHUT + "echo $_GET['q'];"},
    # Queries.
    "sql_plain": {"a.php": _SHUT + "global $wpdb;\n$wpdb->query('DELETE FROM t WHERE a = ' . $_GET['q']);"},
    "sql_prepared": {"a.php": _SHUT + "global $wpdb; $wpdb->query($wpdb->prepare(\"SELECT a FROM {$wpdb->posts} WHERE a = %s\", $_GET['q']));"},
    "sql_template": {"a.php": _SHUT + "global $wpdb;\n$wpdb->prepare('SELECT a FROM t WHERE ' . $_GET['q'], 1);"},
    "sql_number": {"a.php": _SHUT + "global $wpdb; $wpdb->query('DELETE FROM t WHERE a = ' . intval($_GET['q']));"},
    "sql_clause": {"a.php": _SHUT + "add_filter('posts_where', 'w');\nfunction w($sql) {\nreturn $sql . $_GET['q']; }"},
    "sql_link": {"a.php": _SHUT + "mysqli_query($db, $_GET['q']);"},
    "sql_stored": {"a.php": _SHUT + "global $wpdb;\n$n = $wpdb->get_var(\"SELECT COUNT(*) FROM {$wpdb->prefix}t\"); echo $n;\n$t = $wpdb->get_var(\"SELECT title FROM {$wpdb->prefix}t\");\necho $t;"},
    # Calls, objects, rights.
    "call_exec": {"a.php": _SHUT + "system($_GET['c']);"},
    "call_name": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { $f = $_POST['f'];\n$f(); }"},
    "call_name_guarded": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!current_user_can('read')) { return; } $f = $_POST['f'];\n$f(); }"},
    "call_callback": {"a.php": _SHUT + "add_action('wp_ajax_nopriv_a', 'a');\nfunction a() {\ncall_user_func($_POST['f']); }"},
    "call_pair": {"a.php": _SHUT + "add_action('wp_ajax_nopriv_a', 'a');\nfunction a() {\ncall_user_func([$x, $_POST['m']]); }"},
    "object_plain": {"a.php": _SHUT + "unserialize($_COOKIE['c']);\nunserialize($_COOKIE['c'], ['allowed_classes' => false]);"},
    "object_map": {"a.php": _SHUT + "array_map('unserialize', $_POST['c']);"},
    "rights_role": {"a.php": _SHUT + "wp_update_user(['ID' => 1, 'role' => $_POST['r']]);\nwp_insert_user(['role' => 'subscriber', 'user_login' => $_POST['u']]);"},
    "rights_meta": {"a.php": _SHUT + "update_user_meta($id, 'wp_capabilities', $_POST['c']);"},
    "rights_super": {"a.php": _SHUT + "grant_super_admin($_POST['id']);"},
    # Actions, output of records, downloads, redirects.
    "action_money": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() {\n$gateway->refund_payment($_POST['id']); }"},
    "action_config": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { $other->set('k', $_POST['v']);\n$config->set('k', $_POST['v']); }"},
    "record_json": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { $r = get_log_entry($_GET['id']);\nwp_send_json($r); }"},
    "record_guarded": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { if (!current_user_can('manage_options')) { wp_die(); } $r = get_log_entry($_GET['id']);\nwp_send_json($r); }"},
    "record_plain_json": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() { wp_send_json($_GET['id']); }"},
    "upload_move": {"a.php": _SHUT + "add_action('wp_ajax_a', 'a');\nfunction a() {\nmove_uploaded_file($_FILES['f']['tmp_name'], '/x'); }"},
    "redirect_plain": {"a.php": _SHUT + "wp_redirect($_GET['u']);\nheader('Location: ' . $_GET['u']);"},
    # Stores.
    "store_option": {"a.php": _SHUT + "add_action('wp_ajax_nopriv_w', 'w');\nfunction w() { set_transient('k', $_POST['v']); }\nadd_action('wp_ajax_r', 'r');\nfunction r() {\necho get_transient('k'); }"},
    "store_escaped": {"a.php": _SHUT + "echo esc_html(get_option('k'));"},
    "stack_recursion": {"a.php": _SHUT + "function a($x) { b($x); }\nfunction b($x) { a($x);\necho $x; }\na($_GET['q']);"},
    "stack_cycle": {"a.php": _SHUT + "class A extends B {} class B extends A {} (new A())->none($_GET['q']);\necho $_GET['r'];"},
    "clone_mode": {"a.php": _SHUT + "function show($mode, $v) { if ($mode === 'raw') {\necho $v; } else { echo esc_html($v); } }\nshow('safe', $_GET['a']);\nshow('raw', $_GET['b']);"},
    "clone_name": {"a.php": _SHUT + "function run($f, $v) { $f($v); }\nfunction plain($v) {\necho $v; } function other($v) { return 1; }\nrun('other', $_GET['a']);\nrun('plain', $_GET['b']);"},
    "clone_growing": {"a.php": _SHUT + "function grow($s) { if ($s == 'x') { return; } grow($s . 'a'); echo $_GET['q']; }\ngrow('b');"},
    "reader_broken": {"a.php": "<?php if (", "b.php": _SHUT + "echo $_GET['q'];"},
    "reader_empty": {"a.php": "", "b.php": "no program at all"},
}


def program_files(spark: SparkSession, names: tuple[str, ...] = ()) -> DataFrame:
    """(root, path, source) of the cases, or of those named."""
    rows = [(root, path, source) for root, files in PROGRAMS.items() if not names or root in names for path, source in files.items()]
    return spark.createDataFrame(rows, "root string, path string, source string")


#: What must be found: case, rule, place of the sink, line of the source, tier, capability, score.
EXPECTED = """
guard_bare wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated - 400
guard_low wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated read 400
guard_chosen wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated - 400
guard_login wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated - 400
guard_nonce wp-request-sensitive-action-without-cap-check a.php:4 4 nonce_only - 600
helper_no_end wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated - 400
tier_nopriv wp-reflected-xss-direct-request-output a.php:3 3 unauthenticated - 1000
tier_ajax wp-reflected-xss-direct-request-output a.php:3 3 authenticated - 400
tier_shortcode wp-reflected-xss-direct-request-output a.php:3 3 unauthenticated - 1000
tier_admin_init wp-reflected-xss-direct-request-output a.php:3 3 authenticated - 400
tier_loaded wp-reflected-xss-direct-request-output a.php:3 3 unauthenticated - 1000
tier_rest_open wp-reflected-xss-direct-request-output a.php:3 3 unauthenticated - 1000
tier_rest_guard wp-reflected-xss-direct-request-output a.php:3 3 permission_callback - 700
tier_page wp-reflected-xss-direct-request-output a.php:3 3 authenticated - 400
tier_file wp-reflected-xss-direct-request-output a.php:2 2 unknown - 200
name_space wp-reflected-xss-direct-request-output b.php:3 4 unknown - 200
name_closures wp-reflected-xss-direct-request-output a.php:2 2 unauthenticated - 1000
name_chain wp-reflected-xss-direct-request-output a.php:4 5 unknown - 200
name_trait wp-reflected-xss-direct-request-output a.php:3 4 unknown - 200
name_property wp-reflected-xss-direct-request-output a.php:3 4 unknown - 200
name_holes unsafe-use a.php:2 2 unknown - 200
name_holes wp-reflected-xss-direct-request-output a.php:4 2 unknown - 200
name_hook_holes wp-reflected-xss-direct-request-output a.php:4 2 unknown - 200
path_plain request-path-read-delete a.php:2 2 unknown - 200
path_real_branch request-path-read-delete a.php:3 2 unknown - 240
path_inside request-path-read-delete a.php:3 2 unknown - 240
path_helper request-path-read-delete a.php:4 4 unknown - 240
path_include path-transversal a.php:2 2 unknown - 200
delete_guarded request-path-read-delete a.php:4 4 capability_checked manage_options 50
delete_open wp-request-file-delete-without-cap-check a.php:4 4 authenticated - 400
delete_both wp-request-sensitive-action-without-cap-check a.php:57 57 capability_checked manage_options 50
value_constant wp-reflected-xss-direct-request-output a.php:4 4 unknown - 200
value_switch wp-reflected-xss-direct-request-output a.php:3 2 unknown - 200
value_kill wp-reflected-xss-direct-request-output a.php:3 3 unknown - 200
value_number wp-reflected-xss-direct-request-output a.php:3 3 unknown - 200
value_extract wp-reflected-xss-direct-request-output a.php:3 2 unknown - 200
value_include wp-reflected-xss-direct-request-output inc/b.php:2 2 unknown - 200
sql_plain tainted-sql-string a.php:3 3 unknown - 200
sql_template tainted-sql-string a.php:3 3 unknown - 200
sql_clause tainted-sql-string a.php:4 4 unknown - 200
sql_link tainted-sql-string a.php:2 2 unknown - 200
sql_stored wp-stored-xss-persistent-read-to-output a.php:5 4 unknown - 312
call_exec unsafe-use a.php:2 2 unknown - 200
call_name unsafe-use a.php:4 3 authenticated - 400
call_callback render-callback-execution a.php:4 4 unauthenticated - 1000
call_pair unsafe-use a.php:4 4 unauthenticated - 1000
object_plain unsafe-deserialization a.php:2 2 unknown - 200
object_map unsafe-deserialization a.php:2 2 unknown - 200
rights_role wp-request-tainted-privilege-mutation a.php:2 2 unknown - 200
rights_meta wp-request-tainted-privilege-mutation a.php:2 2 unknown - 200
rights_super wp-request-tainted-privilege-mutation a.php:2 2 unknown - 200
action_money wp-ajax-financial-action-without-cap-check a.php:4 4 authenticated - 400
action_config wp-request-sensitive-action-without-cap-check a.php:4 4 authenticated - 400
record_json wp-request-record-read-to-output-without-cap-check a.php:4 3 authenticated - 400
upload_move wp-request-file-upload-without-cap-check a.php:4 4 authenticated - 400
redirect_plain wp-open-redirect a.php:2 2 unknown - 200
redirect_plain wp-header-injection a.php:3 3 unknown - 200
store_option wp-stored-xss-persistent-read-to-output a.php:6 6 authenticated - 1000
stack_recursion wp-reflected-xss-direct-request-output a.php:4 5 unknown - 200
stack_cycle wp-reflected-xss-direct-request-output a.php:3 3 unknown - 200
clone_mode wp-reflected-xss-direct-request-output a.php:3 5 unknown - 200
clone_name wp-reflected-xss-direct-request-output a.php:4 6 unknown - 200
clone_growing wp-reflected-xss-direct-request-output a.php:2 2 unknown - 200
reader_broken wp-reflected-xss-direct-request-output b.php:2 2 unknown - 200
"""
#: Cases whose facts are looked at one by one.
FACT_CASES = (
    "guard_negated", "guard_false", "guard_login", "guard_nonce", "helper_statement", "helper_no_end", "helper_condition", "helper_method", "tier_nopriv",
    "tier_admin_init", "tier_rest_open", "tier_rest_guard", "tier_page", "name_property", "name_holes", "name_hook_holes",
    "value_class_constant", "sql_stored", "store_option", "stack_cycle",
)
#: What must be known of them: case, kind of fact, what it is about, and its value.
EXPECTED_FACTS = """
guard_negated check f:a capability:manage_options
guard_negated check f:a validation:
guard_negated entry f:a ajax/a/authenticated
guard_false check f:a capability:manage_options
guard_false entry f:a ajax/a/authenticated
guard_login check f:a auth:
guard_login entry f:a front_hook/init/unauthenticated
guard_nonce check f:a nonce:
helper_statement check f:a capability:manage_options
helper_statement check f:a validation:
helper_statement check f:allow capability:manage_options
helper_statement check f:allow validation:
helper_statement call f:a f:allow
helper_statement entry f:a ajax/a/authenticated
helper_no_end check f:allow capability:manage_options
helper_no_end call f:a f:allow
helper_no_end entry f:a ajax/a/authenticated
helper_condition check f:a capability:manage_options
helper_condition check f:allow capability:manage_options
helper_condition check f:inner capability:manage_options
helper_condition call f:a f:allow
helper_condition call f:allow f:inner
helper_condition entry f:a ajax/a/authenticated
helper_method check m:a::a capability:manage_options
helper_method check m:a::a validation:
helper_method check m:a::allow capability:manage_options
helper_method check m:a::allow validation:
helper_method call m:a::a m:a::allow
helper_method entry m:a::a ajax/a/authenticated
tier_nopriv entry f:a ajax/a/unauthenticated
tier_admin_init entry f:a front_hook/admin_init/authenticated
tier_rest_open entry f:a rest//n/v1/r/unauthenticated
tier_rest_guard entry f:a rest//n/v1/r/permission_callback
tier_page entry f:a admin_page/id/authenticated
name_property call m:a::run m:s::show
name_holes call m:a::go m:a::do_show
name_hook_holes call file:a.php f:a
value_class_constant constant c::A x
value_class_constant constant c::B xy
sql_stored read file:a.php table:t/title
guard_negated write f:a option/k
guard_false write f:a option/k
guard_login write f:a option/k
guard_nonce write f:a option/k
helper_statement write f:a option/k
helper_no_end write f:a option/k
helper_condition write f:a option/k
helper_method write m:a::a option/k
store_option write f:w transient/k
store_option read f:r transient/k
store_option entry f:r ajax/r/authenticated
store_option entry f:w ajax/w/unauthenticated
"""


def values(text: str, fields: int) -> str:
    """The lines of a table as rows of SQL; the last field of a line takes the rest."""
    rows = [line.split(" ", fields - 1) for line in text.strip().splitlines()]
    return ", ".join("(" + ", ".join("'" + f.replace("'", "''") + "'" for f in row) + ")" for row in rows)


#: Callables of a large program, those of them on a way from an entry to a sink, and how many such programs are scanned at once.
LARGE_CALLABLES, LARGE_RELEVANT, LARGE_PROGRAMS = 1613, 321, 20


def large_programs(spark: SparkSession, programs: int = LARGE_PROGRAMS) -> DataFrame:
    """Programs of many callables: ways of three callables from an entry to a sink, and others that compute."""
    files = {}
    for i in range(LARGE_RELEVANT // 3):
        files[f"way{i}.php"] = (
            _SHUT + f"add_action('wp_ajax_nopriv_{i}', 'enter_{i}');\nfunction enter_{i}() {{ $v = $_POST['v']; if ($v) {{ pass_{i}(trim($v)); }} }}\n"
            f"function pass_{i}($v) {{ $list = ['k' => $v, 'n' => 1]; foreach ($list as $k => $x) {{ show_{i}($list['k']); }} }}\n"
            f"function show_{i}($v) {{\necho '<b>' . $v . '</b>'; }}\n"
        )
    rest = LARGE_CALLABLES - LARGE_RELEVANT
    for i in range(0, rest, 17):
        body = "".join(
            f"function sum_{j}($a, $b) {{ $t = 0; for ($i = 0; $i < $a; $i++) {{ if ($i % 2) {{ $t += $i * $b; }} else {{ $t = $t - 1; }} }} return $t; }}\n"
            for j in range(i, min(i + 17, rest))
        )
        files[f"sum{i}.php"] = _SHUT + body
    rows = spark.createDataFrame(list(files.items()), "path string, source string")
    return rows.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(programs - 1)))).selectExpr("concat('large', root) AS root", "path", "source")


#: Programs with signals of weak design, each with its counterpart.
SURFACES: dict[str, dict[str, str]] = {
    "secret_route": {"a.php": _SHUT + "$t = get_option('api_token');\nregister_rest_route('x/v1', '/hook/' . $t, ['callback' => 'c']);"},
    "secret_hidden": {"a.php": _SHUT + "$t = get_option('api_token');\nregister_rest_route('x/v1', '/hook/' . $t, ['callback' => 'c', 'show_in_index' => false]);\nregister_rest_route('x/v1', '/' . get_option('title'), ['callback' => 'c']);"},
    "token_open": {"a.php": _SHUT + "register_rest_route('x/v1', '/t', ['callback' => 't']);\nfunction t($r) { return rest_ensure_response(['token' =>\ncreate_token($_POST['scope'])]); }"},
    "token_validated": {"a.php": _SHUT + "register_rest_route('x/v1', '/t', ['callback' => 't']);\nfunction t($r) {\nvalidate_token($token);\nreturn ['token' => create_token($_POST['scope'])]; }"},
    "token_no_route": {"a.php": _SHUT + "add_action('wp_ajax_t', 't');\nfunction t($r) { return ['token' => create_token($_POST['scope'])]; }"},
    "link_issued": {"a.php": _SHUT + "class L { function issue() { wp_send_json(['login_url' =>\nhome_url() . '/?magic_login=' . $k]); }\nfunction take() { if ($_GET['magic_login']) {\nwp_set_auth_cookie(1); } } }"},
    "link_other_key": {"a.php": _SHUT + "class L { function issue() { wp_send_json(['login_url' => home_url() . '/?magic_login=' . $k]); }\nfunction take() { if ($_GET['page']) { wp_set_auth_cookie(1); } } }"},
    "oauth_open": {"a.php": _SHUT + "class O { function __construct() { add_action('init', [$this, 'handle_callback']); }\nfunction handle_callback() { $c = $_GET['code'];\n$this->finish($c); }\nfunction finish($c) { $this->sign_in(); }\nfunction sign_in() {\nwp_set_auth_cookie(1); } }"},
    "oauth_closed": {"a.php": _SHUT + "class O { function __construct() { add_action('init', [$this, 'handle_callback']); }\nfunction handle_callback() { $c = $_GET['code'];\nif (!get_option('users_can_register')) { return; }\n$this->sign_in($c); }\nfunction sign_in() { wp_set_auth_cookie(1); } }"},
    "name_weak": {"a.php": _SHUT + "class N { function uid($n) {\nreturn substr(str_shuffle(str_repeat('0123456789', $n)), 0, $n); }\nfunction export() { $u = $this->uid(8);\nreturn '/tmp/' . $u . '.sql'; } }"},
    "name_strong": {"a.php": _SHUT + "class N { function uid($n) {\nreturn substr(str_shuffle(str_repeat('0123456789', $n)), 0, $n); }\nfunction export() { $u = $this->uid(12);\nreturn '/tmp/' . $u . '.sql'; } }"},
    "upload_piece": {"a.php": _SHUT + "add_filter('wp_check_filetype_and_ext', 'u');\nfunction u($data, $file, $filename) {\nif (strpos($filename, '.svg') !== false) {\n$data['ext'] = 'svg'; } return $data; }"},
    "upload_exact": {"a.php": _SHUT + "add_filter('wp_check_filetype_and_ext', 'u');\nfunction u($data, $file, $filename) { $ext = pathinfo($filename, 4);\nif (strpos($filename, '.svg') !== false && 'svg' === $ext) { $data['ext'] = 'svg'; } return $data; }"},
}
#: What must be signalled: case, rule, place of the sink, line of the source.
EXPECTED_SURFACES = """
secret_route wp-rest-public-data-disclosure-surface a.php:3 2
token_open wp-rest-token-issuance-surface a.php:4 4
link_issued wp-issued-auth-link-surface a.php:5 3
oauth_open wp-public-oauth-callback-auth-surface a.php:7 3
name_weak predictable-security-identifier-surface a.php:5 3
upload_piece upload-api-surface a.php:5 4
"""


def surface_files(spark: SparkSession) -> DataFrame:
    rows = [(root, path, source) for root, files in SURFACES.items() for path, source in files.items()]
    return spark.createDataFrame(rows, "root string, path string, source string")


#: A program that uses functions of its own which a model table tells of.
OWN_MODELS = _SHUT + "own_sink('x', $_GET['a']); own_sink($_GET['b'], 'x');\n$v = own_input();\n$o->own_write($v);\necho $v; echo own_clean($v);"


def model_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("own", "a.php", OWN_MODELS)], "root string, path string, source string")

"""Models of sources, sanitizers and sinks as plain tables.

Fixed values: names, argument positions, rule ids and messages must equal the
documented behaviour for results to agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Request arrays.
SUPERGLOBALS = "_GET _POST _REQUEST _COOKIE _FILES".split()
#: Keys of _SERVER that a request controls, beside those that start with HTTP_.
SERVER_KEYS = "REQUEST_URI PATH_INFO REDIRECT_URL DOCUMENT_URI HTTP_HOST QUERY_STRING PHP_SELF PATH_TRANSLATED ORIG_PATH_INFO".split()
#: Functions and methods that return request data, and functions that return remote responses.
REQUEST_FUNCTIONS = "filter_input filter_input_array getallheaders apache_request_headers rgpost rgget rgpost_array rgget_array".split()
REQUEST_METHODS = """get_json_params get_body_params get_query_params get_file_params get_params get_param get_value get_header
get_headers get_route_params getip get_ip getvar getint getcmd getstring getbool getarray getfloat""".split()
REMOTE_FUNCTIONS = "wp_remote_get wp_remote_post wp_remote_request wp_safe_remote_get wp_safe_remote_post".split()
#: Functions whose result carries what goes in.
PROPAGATORS = """rawurldecode urldecode rawurlencode urlencode base64_decode base64_encode substr trim ltrim rtrim strtok
parse_url wp_parse_url str_replace preg_replace dirname basename realpath maybe_serialize maybe_unserialize json_encode
wp_json_encode json_decode array_merge array_intersect_key array_map array_filter implode join explode reset acf_get_array
acfe_parse_types acfe_parse_args_r wp_parse_args shortcode_atts plugins_api wp_remote_retrieve_body esc_sql
sanitize_sql_orderby sanitize_text_field sanitize_textarea_field sanitize_key sanitize_email sanitize_title sanitize_url
wp_unslash wp_normalize_path esc_html esc_attr esc_url esc_url_raw wp_kses wp_kses_post stream_get_contents fread fgets
fgetss stream_get_line""".split()
#: Functions whose result is safe in HTML, and those that undo it.
HTML_SAFE = """wp_kses_post wp_kses_data esc_html esc_html__ esc_html_e esc_html_x esc_attr esc_attr__ esc_attr_e esc_attr_x
esc_textarea wp_strip_all_tags htmlspecialchars htmlentities sanitize_text_field sanitize_textarea_field sanitize_key
sanitize_email sanitize_title sanitize_html_class esc_url esc_url_raw sanitize_url rawurlencode urlencode http_build_query
esc_js json_encode wp_json_encode selected checked disabled wp_readonly esc_xml tag_escape sanitize_hex_color
sanitize_hex_color_no_hash sanitize_mime_type wp_filter_nohtml_kses antispambot number_format number_format_i18n wc_clean
wc_sanitize_tooltip wc_sanitize_textarea wc_strtolower wc_sanitize_taxonomy_name""".split()
HTML_UNSAFE = "html_entity_decode htmlspecialchars_decode".split()
#: Functions that leave a number; functions that leave a bare file name.
NUMERIC = "intval absint floatval doubleval boolval count strlen".split()
PATH_SAFE = "basename wp_basename sanitize_file_name".split()

REFLECTED, STORED, RECORD = (
    "wp-reflected-xss-direct-request-output",
    "wp-stored-xss-persistent-read-to-output",
    "wp-request-record-read-to-output-without-cap-check",
)
INCLUDE, PATH, DELETE, UPLOAD = (
    "path-transversal",
    "request-path-read-delete",
    "wp-request-file-delete-without-cap-check",
    "wp-request-file-upload-without-cap-check",
)
SQL, USE, OBJECT, PRIVILEGE = "tainted-sql-string", "unsafe-use", "unsafe-deserialization", "wp-request-tainted-privilege-mutation"
ACTION, REDIRECT, HEADER = "wp-request-sensitive-action-without-cap-check", "wp-open-redirect", "wp-header-injection"
FINANCIAL, RENDER = "wp-ajax-financial-action-without-cap-check", "render-callback-execution"
#: Rules of the opt-in operation ``surface``.
DISCLOSURE, TOKEN, AUTH_LINK, OAUTH, IDENTIFIER, UPLOAD_API = (
    "wp-rest-public-data-disclosure-surface",
    "wp-rest-token-issuance-surface",
    "wp-issued-auth-link-surface",
    "wp-public-oauth-callback-auth-surface",
    "predictable-security-identifier-surface",
    "upload-api-surface",
)
#: Rule, operation, and where its arguments are: function names by argument positions.
FUNCTION_SINKS: list[tuple[str, str, str, tuple[int, ...]]] = [
    (PATH, "read", "file_get_contents readfile file parse_ini_file simplexml_load_file", (0,)),
    (PATH, "open", "fopen", (0,)),
    (PATH, "delete", "unlink rmdir wp_delete_file", (0,)),
    (UPLOAD, "write", "move_uploaded_file copy rename stream_copy_to_stream unzip_file file_put_contents", (0, 1)),
    (UPLOAD, "write", "fwrite fputs", (1,)),
    (UPLOAD, "write", "wp_upload_bits", (0, 2)),
    (UPLOAD, "write", "download_url wp_handle_sideload wp_handle_upload media_handle_sideload", (0,)),
    (ACTION, "action", "update_option add_option update_site_option add_site_option", (0, 1)),
    (ACTION, "action", "add_post_meta update_post_meta", (1, 2)),
    (
        ACTION,
        "action",
        "add_user_meta update_user_meta delete_user_meta add_term_meta update_term_meta delete_term_meta add_comment_meta"
        " update_comment_meta delete_comment_meta wp_create_user wp_insert_attachment",
        (0, 1, 2),
    ),
    (
        ACTION,
        "action",
        "wp_insert_post wp_update_post delete_option delete_site_option delete_network_option wp_delete_post wp_trash_post"
        " wp_delete_attachment wp_delete_user wp_delete_comment wp_delete_term switch_to_blog activate_plugin"
        " deactivate_plugins delete_plugins uninstall_plugin",
        (0,),
    ),
    (USE, "call", "assert exec system passthru shell_exec popen proc_open pcntl_exec", (0,)),
    (USE, "call", "create_function", (1,)),
    (OBJECT, "call", "unserialize maybe_unserialize", (0,)),
    (PRIVILEGE, "call", "grant_super_admin", (0,)),
    (REDIRECT, "action", "wp_redirect", (0,)),
    (HEADER, "action", "header", (0,)),
    (SQL, "sql", "mysql_query mysql_unbuffered_query", (0,)),
    (REFLECTED, "output", "printf vprintf print_r var_dump wp_die", (0, 1, 2, 3)),
]
#: Outgoing requests; listed for those who want them, no scan looks for them.
OUTGOING_REQUESTS = """wp_remote_get wp_remote_post wp_remote_request wp_remote_head wp_remote_fopen
wp_remote_retrieve_body_from_url wp_safe_remote_get wp_safe_remote_post wp_safe_remote_request wp_safe_remote_head""".split()
#: Functions that call what their first argument names; functions that send data as JSON; that send a file.
DYNAMIC_CALLS = "call_user_func call_user_func_array forward_static_call forward_static_call_array".split()
JSON_OUTPUT = "wp_send_json wp_send_json_success wp_send_json_error".split()
DOWNLOADS = "readfile fpassthru".split()
#: Functions that read the request body when their first argument is php://input.
BODY_READERS = "file_get_contents file readfile fopen fgets fgetss stream_get_contents".split()
#: A name reads records if it starts with one of the first and holds one of the second.
RECORD_PREFIXES = "get read fetch find load retrieve lookup query".split()
RECORD_MARKERS = "log record entry message content transcript detail details mail email".split()
#: Functions that take the role of a user under this key, and ends of meta keys that hold rights.
ROLE_FUNCTIONS, ROLE_KEY = "wp_insert_user wp_update_user".split(), "role"
RIGHTS_META_FUNCTIONS, RIGHTS_META = "update_user_meta add_user_meta".split(), ("capabilities", "user_level")
#: Filters whose callbacks return a part of a query.
SQL_CLAUSE_HOOKS = """posts_search posts_search_orderby posts_where posts_join posts_groupby posts_orderby posts_distinct
post_limits posts_fields posts_where_request posts_join_request posts_groupby_request posts_orderby_request
posts_distinct_request post_limits_request posts_fields_request posts_request get_meta_sql""".split()
#: Fixed value: the filter that decides whether an upload is allowed.
UPLOAD_FILTER = "wp_check_filetype_and_ext"
#: Query functions whose connection comes first if there are two arguments.
LINK_FIRST = "mysqli_query mysqli_multi_query mysqli_real_query mysqli_send_query mysqli_prepare pg_query pg_send_query sqlsrv_query".split()
#: The same for methods.
METHOD_SINKS: list[tuple[str, str, str, tuple[int, ...]]] = [
    (PRIVILEGE, "call", "set_role add_role add_cap", (0,)),
    (PATH, "read", "get_contents", (0,)),
    (PATH, "delete", "delete", (0,)),
    (UPLOAD, "write", "put_contents move copy", (0, 1)),
    (UPLOAD, "write", "extract extractto", (0,)),
    (ACTION, "action", "set", (1,)),
    (ACTION, "action", "install", (0,)),
    (FINANCIAL, "action", "refund_payment cancel_subscription", (0,)),
    (SQL, "sql", "query get_var get_row get_col get_results execute executequery multi_query real_query send_query", (0,)),
    (SQL, "sql", "prepare where_raw whereraw orwhereraw select_raw selectraw join_raw joinraw having_raw havingraw order_by_raw orderbyraw", (0,)),
]
#: Receivers of the methods that are too common by name to be sinks on anything.
METHOD_RECEIVERS = {
    "extract": ("zip", "archive", "tar", "phar"),
    "set": ("config", "settings", "options", "option"),
    "install": ("installer", "upgrader"),
    "delete": ("filesystem", "fs"),
    "move": ("filesystem", "fs"),
    "copy": ("filesystem", "fs"),
    "query": ("wpdb", "db", "mysqli", "pdo", "database", "conn"),
    "execute": ("wpdb", "db", "mysqli", "pdo", "database", "conn", "stmt"),
    "prepare": ("wpdb", "db", "mysqli", "pdo", "database", "conn"),
}
#: Reads and writes of what outlives a request: function, family, position of the key, of the value.
STORE_READS = [
    ("get_option get_site_option", "option", 0),
    ("get_transient get_site_transient", "transient", 0),
    ("get_metadata", "meta", 2),
    ("get_post_meta", "post_meta", 1),
    ("get_user_meta", "user_meta", 1),
    ("get_term_meta", "term_meta", 1),
    ("get_post", "post", 0),
]
STORE_WRITES = [
    ("add_option update_option add_site_option update_site_option", "option", 0, 1),
    ("set_transient set_site_transient", "transient", 0, 1),
    ("add_metadata update_metadata", "meta", 2, 3),
    ("add_post_meta update_post_meta", "post_meta", 1, 2),
    ("add_user_meta update_user_meta", "user_meta", 1, 2),
    ("add_term_meta update_term_meta", "term_meta", 1, 2),
]
#: Checks by what they prove. Which of their calls count is for ``taint_guards``.
CHECKS = {
    "capability": "current_user_can user_can current_user_can_for_blog author_can",
    "nonce": "wp_verify_nonce check_ajax_referer check_admin_referer",
    "auth": "is_user_logged_in wp_validate_auth_cookie auth_redirect",
}
#: Hooks whose registration makes a callback an entry: name, or start of one that ends in a bar; kind, tier.
#: The first that fits holds.
ENTRY_HOOKS = [
    ("wp_ajax_nopriv_", "ajax", "unauthenticated"),
    ("wp_ajax_", "ajax", "authenticated"),
    ("admin_post_nopriv_", "admin_post", "unauthenticated"),
    ("admin_post_", "admin_post", "authenticated"),
    ("admin_init", "front_hook", "authenticated"),
    ("muplugins_loaded", "front_hook", "unauthenticated"),
    ("plugins_loaded", "front_hook", "unauthenticated"),
    ("init", "front_hook", "unauthenticated"),
    ("wp_loaded", "front_hook", "unauthenticated"),
    ("parse_request", "front_hook", "unauthenticated"),
    ("template_redirect", "front_hook", "unauthenticated"),
    ("wp", "front_hook", "unauthenticated"),
    ("rest_api_init", "rest_init", "unknown"),
]
#: Rules that a capability check in the context suppresses.
GUARDED_RULES = (UPLOAD, DELETE, ACTION, FINANCIAL, RECORD)
#: Roles that may be granted freely.
LOW_ROLES = ("subscriber", "customer")


def reads_records(name: str) -> bool:
    """Whether a function or method of this name reads records."""
    name = name.lstrip("\\").lower().rsplit("\\", 1)[-1]
    return name.startswith(tuple(RECORD_PREFIXES)) and any(m in name for m in RECORD_MARKERS)


def join_route(namespace: str, route: str) -> str:
    """A route below its namespace, with one bar between."""
    namespace, route = namespace.strip("/"), route.strip()
    if not namespace:
        return route
    return f"/{namespace}" + (route if not route or route.startswith("/") else f"/{route}")


def by_name(table: list[tuple], column: int) -> dict[str, list[tuple]]:
    """Rows of a model table by each of the names in a column."""
    out: dict[str, list[tuple]] = {}
    for row in table:
        for name in row[column].split():
            out.setdefault(name, []).append(row)
    return out


#: Columns of a model table: what it is (function, method, source or sanitizer), the name, and for sinks rule, operation and arguments.
MODEL_SCHEMA = "kind string, name string, rule string, op string, positions array<int>"
#: Most rows of a table of further models; they are read into the driver and handed to the workers.
MOST_MODELS = 50_000


def model_table(spark: SparkSession) -> DataFrame:
    """The models of this module as a table of ``MODEL_SCHEMA``, to be looked at, joined with calls, or added to."""
    rows = [("function", n, rule, op, list(at)) for rule, op, names, at in FUNCTION_SINKS for n in names.split()]
    rows += [("method", n, rule, op, list(at)) for rule, op, names, at in METHOD_SINKS for n in names.split()]
    rows += [("source", n, None, None, None) for n in [*REQUEST_FUNCTIONS, *REMOTE_FUNCTIONS]]
    rows += [("sanitizer", n, None, flag, None) for flag, names in (("html", HTML_SAFE), ("number", NUMERIC), ("path", PATH_SAFE)) for n in names]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def further_models(models: DataFrame) -> dict[str, dict[str, list]]:
    """Rows of a model table by kind and name; null names are none. Raises beyond ``MOST_MODELS`` rows."""
    rows = models.where(F.col("name").isNotNull()).select("kind", F.lower("name").alias("name"), "rule", "op", "positions").distinct().limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    out: dict[str, dict[str, list]] = {"function": {}, "method": {}, "source": {}, "sanitizer": {}}
    for r in sorted(rows, key=str):
        out.setdefault(r.kind, {}).setdefault(r.name, []).append((r.rule, r.op, r.name, tuple(r.positions or ())))
    return out

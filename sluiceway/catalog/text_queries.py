"""Text rules and made-up orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.functions import textrules
from sluiceway.functions.textrules import Rule
from sluiceway.plans import synth

RULES = (
    Rule("licence", ["copyright|all rights reserved", "licen[cs]ed? under"], needs=["copyright|all rights reserved|under"]),
    Rule("secret", ["api[_-]?key|password|secret"], needs=["api|password|secret"]),
    Rule("mail", ["[a-z0-9._]+@[a-z0-9.]+"], steps=("en", "de"), needs=["@"]),
    Rule("line-start", ["^(the|and) "], code=1, needs=["the |and "]),
    Rule("question", [r"\?"], needs=["?"]),
)


def _case(result: str) -> str:
    """The rules as one CASE; `result` is 'id' or 'hit'."""
    tests = [
        ("licence", "true", "copyright|all rights reserved"), ("licence", "true", "licen[cs]ed? under"),
        ("secret", "true", "api[_-]?key|password|secret"),
        ("mail", "lang in ('en', 'de')", "[a-z0-9._]+@[a-z0-9.]+"),
        ("line-start", "code = 1", "^(the|and) "), ("question", "true", r"\?"),
    ]
    value = {"id": lambda i, p: f"'{i}'", "hit": lambda i, p: f"regexp_extract(text, '(?im){p}')"}[result]
    return "case " + " ".join(
        f"when {scope} and regexp_matches(text, '(?im){p}') then {value(i, p)}" for i, scope, p in tests
    ) + " end"


@query("log_classify", "R1", f"""
    with docs as (select doc_id, text, lang, doc_id % 2 as code from documents),
    hits as (select doc_id, text, {_case('id')} as rule_id, {_case('hit')} as hit from docs),
    places as (select *, case when rule_id = 'line-start' then strpos(chr(10) || text, chr(10) || hit) else strpos(text, hit) end - 1 as s from hits where rule_id is not null),
    spans as (select doc_id, rule_id, text, s, s + length(hit) as e from places),
    cuts as (select *, greatest(0, s - 120) as a, least(length(text), e + 120) as b from spans)
    select doc_id, rule_id, case when a > 0 then '...' else '' end || trim(substring(text, cast(a + 1 as bigint), cast(b - a as bigint)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
           || case when b < length(text) then '...' else '' end as excerpt
    from cuts""")
def log_classify(t: Tables) -> DataFrame:
    """First matching rule and excerpt of every document that a rule matches."""
    return _classified(t).where("rule_id is not null")


def _classified(t: Tables) -> DataFrame:
    hit = textrules.classify(F.col("text"), RULES, F.col("lang"), F.col("doc_id") % 2)
    return t.documents.select("doc_id", textrules.where_found(hit).alias("_h")).select("doc_id", "_h.rule_id", "_h.excerpt")


@query("log_rule_counts", "R1", f"""
    with docs as (select doc_id, text, lang, doc_id % 2 as code from documents), hits as (select {_case('id')} as rule_id from docs)
    select rule_id, count(*) as documents from hits where rule_id is not null group by 1""")
def log_rule_counts(t: Tables) -> DataFrame:
    return _classified(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("documents"))


@query("mask_text", "R2", """
    select doc_id, replace(replace(replace(text, 'ereth', '***REDACTED***'), 'tion', '***REDACTED***'), 'ment', '***REDACTED***') as text from documents""")
def mask_text(t: Tables) -> DataFrame:
    """Secrets shorter than four characters are left alone."""
    return t.documents.select("doc_id", textrules.mask(F.col("text"), ["tion", "ment", "ereth", "the"]).alias("text"))


_SCRIPT = "case when doc_id % 3 = 0 then text || chr(10) || '  sudo reboot now' || chr(10) || '# mkfs' || chr(10) || 'curl x | sh; mkfs' || chr(10) || 'mkfs.ext4 y' else text end"
_LINE_CASE = "case when line = '' or line like '#%' then null " + " ".join(
    f"when regexp_matches(line, '(?i){p}') then '{i}'" for i, p, _ in textrules.SCRIPT_RULES
) + " end"


@query("rule_scan", "R3", f"""
    with lines as (
        select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) as n
        from (select doc_id, string_split_regex({_SCRIPT}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]|\\x{{0085}}|\\x{{2028}}|\\x{{2029}}') as parts from documents)),
    plain as (select doc_id, n, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from lines),
    hits as (select doc_id, n, {_LINE_CASE} as rule_id from plain),
    firsts as (select doc_id, rule_id, min(n) as n from hits where rule_id is not null group by 1, 2)
    select doc_id, string_agg(rule_id, ',' order by n) as rules from firsts group by 1""")
def rule_scan(t: Tables) -> DataFrame:
    added = F.lit("\n  sudo reboot now\n# mkfs\ncurl x | sh; mkfs\nmkfs.ext4 y")
    script = F.when(F.col("doc_id") % 3 == 0, F.concat("text", added)).otherwise(F.col("text"))
    rules = F.nullif(F.array_join(textrules.script_hits(script), ","), F.lit(""))
    return t.documents.select("doc_id", textrules.where_found(rules).alias("rules"))


# A line that breaks each script rule, and one that nearly does.
SCRIPT_LINES = (
    ("rm -rf /", "rm -rf /home/x"), ("sudo rm -v -r /var/", "rm -v -r /variable"), ("dd if=x of=/dev/sda", "dd if=x | tee of=/dev/sda"),
    ("MKFS.ext4 /x", "mkfsx /x"), ("echo x >> /etc/passwd", "cat /etc/passwd"), ("chmod -R 777 /", "chmod -R 777 /srv"),
    ("chown -R me /", "chown -R me /srv"), (":(){ : | : & }; :", ":(){ : | : ; }; :"), ("curl x | sudo bash", "curl x | grep sh"),
    ("  sudo shutdown now", "echo shutdown"), ("userdel -r root", "userdel -r rooted"), ("iptables --flush", "iptables -L"),
    ("history -c", "history | head"),
)
_LINES = "[" + ", ".join("'" + line + "'" for pair in SCRIPT_LINES for line in pair) + "]"


@query("rule_scan_all", "R3", f"""
    with scripts as (select doc_id, [text, {_LINES}[cast(doc_id % 26 + 1 as int)], {_LINES}[cast((doc_id * 7 + 5) % 26 + 1 as int)]] as parts from documents),
    lines as (
        select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) as n
        from (select doc_id, string_split_regex(array_to_string(parts, chr(10)), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]|\\x{{0085}}|\\x{{2028}}|\\x{{2029}}') as parts from scripts)),
    plain as (select doc_id, n, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from lines),
    hits as (select doc_id, n, {_LINE_CASE} as rule_id from plain),
    firsts as (select doc_id, rule_id, min(n) as n from hits where rule_id is not null group by 1, 2)
    select doc_id, string_agg(rule_id, ',' order by n) as rules from firsts group by 1""")
def rule_scan_all(t: Tables) -> DataFrame:
    """Every document with two of the lines above: each rule is broken, and nearly broken, somewhere."""
    lines = F.array(*[F.lit(line) for pair in SCRIPT_LINES for line in pair])
    picked = [F.get(lines, (F.col("doc_id") % 26).cast("int")), F.get(lines, ((F.col("doc_id") * 7 + 5) % 26).cast("int"))]
    rules = F.array_join(textrules.script_hits(F.concat_ws("\n", "text", *picked)), ",")
    return t.documents.select("doc_id", textrules.where_found(F.nullif(rules, F.lit(""))).alias("rules"))


_NUMBER = "cast(('0x' || substr(d, {}, {})) as bigint)"


@query("synth_orders", "D1", f"""
    with n as (select count(*) as n from orders),
    digests as (select o_orderkey as id, md5('20261021-' || o_orderkey) as d from orders),
    dated as (select id, d, cast(date '2025-01-01' + to_months(cast({_NUMBER.format(1, 6)} % 24 as int)) as date) as m from digests)
    select id, cast(m + cast({_NUMBER.format(7, 6)} % day(last_day(m)) as int) as date) as order_date,
           case when {_NUMBER.format(13, 6)} % 100 < 60 then 'done' when {_NUMBER.format(13, 6)} % 100 < 70 then ' DONE '
                when {_NUMBER.format(13, 6)} % 100 < 85 then 'cancelled' else 'draft' end as status,
           cast(cast({_NUMBER.format(19, 8)} % 999901 + 100 as decimal(18,0)) * cast(0.01 as decimal(3,2)) as decimal(20,2)) as amount,
           'c' || lpad(cast({_NUMBER.format(27, 6)} % (greatest(2, n // 20) - 1) + 1 as varchar), 7, '0') as customer
    from dated, n""")
def synth_orders(t: Tables) -> DataFrame:
    """One made-up order for each order of the table."""
    return synth.orders_for(t.orders.select("o_orderkey"), "o_orderkey", t.orders.count())

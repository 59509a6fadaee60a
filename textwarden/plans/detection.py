"""One query a detector: every order plants a value in a text, and SQL says which of them count.

Texts are expressions that Spark and SQL read alike, over the keys of ``orders``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.detectors import DEFAULT_ENTITIES, Custom, ScanConfig
from textwarden.operators import scan
from textwarden.plans.registry import query
from textwarden.sources.tables import read_table

#: Digits at odd and even places of nine digits from the key, for the check digits of a national id.
NINE = "lpad(cast(100000000 + o_orderkey % 800000000 as string), 9, '0')"
_D = lambda i: f"cast(substr({NINE}, {i}, 1) as int)"
ODD, EVEN = "(" + " + ".join(_D(i) for i in (1, 3, 5, 7, 9)) + ")", "(" + " + ".join(_D(i) for i in (2, 4, 6, 8)) + ")"
TENTH = f"((({ODD} * 7 - {EVEN}) % 10 + 10) % 10)"
NATIONAL = f"{NINE} || cast({TENTH} as string) || cast(({ODD} + {EVEN} + {TENTH} + o_orderkey % 2) % 10 as string)"
TAX_NINE = "lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0')"
TAX_SUM = "(" + " + ".join(f"((cast(substr({TAX_NINE}, {i}, 1) as int) + {10 - i}) % 10) * {1 << (10 - i)} % 9" for i in range(1, 10)) + ")"
TAX = f"{TAX_NINE} || cast((10 - {TAX_SUM} % 10 + o_orderkey % 3) % 10 as string)"
BBAN = "lpad(cast(o_orderkey as string), 18, '0')"
IBAN = f"'DE' || lpad(cast(98 - (o_orderkey * 1000000 + 131400) % 97 + case when o_orderkey % 3 = 0 then 1 else 0 end as string), 2, '0') || {BBAN}"
HASH = "md5(cast(o_orderkey as string))"
SSN = "lpad(cast(o_orderkey % 1000 as string), 3, '0') || '-' || lpad(cast(o_orderkey % 98 as string), 2, '0') || '-' || lpad(cast(o_orderkey % 9973 as string), 4, '0')"
CARD = "'4' || lpad(cast(o_orderkey * 31 as string), 15, '0')"
LUHN = f"list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 1 then reverse({CARD})[i]::int when reverse({CARD})[i]::int > 4 then reverse({CARD})[i]::int * 2 - 9 else reverse({CARD})[i]::int * 2 end)) % 10 = 0"

#: Name of the query: entity, text, the part of it that is found, and in which rows.
CASES = {
    "detect_card": ("CREDIT_CARD", f"'card ' || {CARD} || ' ok'", CARD, LUHN),
    "detect_iban": ("IBAN", f"'account ' || {IBAN} || '.'", IBAN, "o_orderkey % 3 <> 0"),
    "detect_mac": ("MAC_ADDRESS", f"'nic ' || substr({HASH}, 1, 2) || ':' || substr({HASH}, 3, 2) || ':' || substr({HASH}, 5, 2) || ':' || substr({HASH}, 7, 2) || ':' || substr({HASH}, 9, 2) || ':' || substr({HASH}, 11, 2) || ' up'", f"substr({HASH}, 1, 2) || ':' || substr({HASH}, 3, 2) || ':' || substr({HASH}, 5, 2) || ':' || substr({HASH}, 7, 2) || ':' || substr({HASH}, 9, 2) || ':' || substr({HASH}, 11, 2)", "true"),
    "detect_ssn": ("SSN", f"'for ' || {SSN} || ' only'", SSN, "o_orderkey % 1000 not in (0, 666) and o_orderkey % 1000 < 900 and o_orderkey % 98 > 0 and o_orderkey % 9973 > 0"),
    "detect_national_id": ("NATIONAL_ID", f"'holder ' || {NATIONAL} || ';'", NATIONAL, "o_orderkey % 2 = 0"),
    "detect_tax_id": ("TAX_ID", f"'tax no ' || {TAX}", TAX, f"o_orderkey % 3 = 0 and length(replace({TAX}, substr({TAX}, 1, 1), '')) > 0"),
    "detect_phone": ("PHONE", "'call +1 (' || cast(200 + o_orderkey % 800 as string) || ') 555-' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || ' now'", "'+1 (' || cast(200 + o_orderkey % 800 as string) || ') 555-' || lpad(cast(o_orderkey % 10000 as string), 4, '0')", "true"),
    "detect_plate": ("LICENSE_PLATE", "'car ' || lpad(cast(o_orderkey % 90 as string), 2, '0') || ' ABC ' || cast(100 + o_orderkey % 900 as string) || ' in'", "lpad(cast(o_orderkey % 90 as string), 2, '0') || ' ABC ' || cast(100 + o_orderkey % 900 as string)", "o_orderkey % 90 between 1 and 81"),
    "detect_vendor_token": ("SECRET", f"'use ' || case o_orderkey % 3 when 0 then 'AKIA' || upper(substr({HASH}, 1, 16)) when 1 then 'ghp_' || {HASH} || substr({HASH}, 1, 4) else 'glpat-' || substr({HASH}, 1, 20) end || ' here'", f"case o_orderkey % 3 when 0 then 'AKIA' || upper(substr({HASH}, 1, 16)) when 1 then 'ghp_' || {HASH} || substr({HASH}, 1, 4) else 'glpat-' || substr({HASH}, 1, 20) end", "true"),
    "detect_private_key": ("SECRET", f"'see -----BEGIN RSA PRIVATE KEY-----' || chr(10) || {HASH} || chr(10) || '-----END RSA PRIVATE KEY----- end'", f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {HASH} || chr(10) || '-----END RSA PRIVATE KEY-----'", "true"),
    "detect_webhook": ("SECRET", f"'post https://hooks.slack.com/services/T' || upper(substr({HASH}, 1, 8)) || '/' || substr({HASH}, 9, 20) || ' done'", f"'https://hooks.slack.com/services/T' || upper(substr({HASH}, 1, 8)) || '/' || substr({HASH}, 9, 20)", "true"),
    "detect_auth_header": ("SECRET", f"'Authorization: Bearer ' || {HASH}", HASH, "true"),
    "detect_spaced_assignment": ("SECRET", f"case o_orderkey % 2 when 0 then 'db password x7' || {HASH} || ' ok' else 'the token budgets are large' end", f"'x7' || {HASH}", "o_orderkey % 2 = 0"),
    "detect_attribute_secret": ("SECRET", f"case o_orderkey % 4 when 0 then '<add key=\"DbPassword\" value=\"' || {HASH} || '\"/>' when 1 then '<input value=\"' || {HASH} || '\" type=\"password\">' when 2 then '<db.password> ' || {HASH} || ' </db.password>' else '<add key=\"Colour\" value=\"' || {HASH} || '\"/>' end", HASH, "o_orderkey % 4 < 3"),
    "detect_env_fallback": ("SECRET", f"case o_orderkey % 3 when 0 then 'x = os.getenv(\"DB_PASSWORD\", \"' || {HASH} || '\")' when 1 then 'let x = process.env.API_KEY || ''' || {HASH} || '''' else 'os.getenv(\"COLOUR\", \"' || {HASH} || '\")' end", HASH, "o_orderkey % 3 < 2"),
    "detect_uri_userinfo": ("SECRET", f"'get https://user:' || {HASH} || '@host.example.com/x'", f"'user:' || {HASH}", "true"),
    "detect_db_uri": ("DB_URI", f"'dsn postgres://app:' || {HASH} || '@db.internal:5432/x'", f"'app:' || {HASH}", "true"),
    "detect_encoded_secret": ("SECRET", f"'blob ' || base64('token=\"' || substr({HASH}, 1, 24) || '\"') || ' end'", f"base64('token=\"' || substr({HASH}, 1, 24) || '\"')", f"length(translate(substr({HASH}, 1, 24), '0123456789', '')) > 0"),
    "detect_basic_auth": ("SECRET", f"'_auth = ' || base64('user:' || substr({HASH}, 1, 13))", f"base64('user:' || substr({HASH}, 1, 13))", "true"),
    "detect_custom": ("CUSTOM", "'see TCK-' || lpad(cast(o_orderkey as string), greatest(6 + cast(o_orderkey % 2 as int), length(cast(o_orderkey as string))), '0') || ' and more'", "'TCK-' || lpad(cast(o_orderkey as string), 6, '0')", "o_orderkey % 2 = 0 and o_orderkey < 1000000"),
    "detect_written_email": ("EMAIL", "'mail john' || cast(o_orderkey as string) || ' [at] example.com today'", "'john' || cast(o_orderkey as string) || ' [at] example.com'", "true"),
    "detect_ipv6": ("IP_ADDRESS", f"'via 2001:db8::' || substr({HASH}, 1, 4) || ' out'", f"'2001:db8::' || substr({HASH}, 1, 4)", "true"),
    "skip_own_placeholders": ("SECRET", f"case o_orderkey % 2 when 0 then 'password = \"<SECRET_' || cast(o_orderkey % 9 + 1 as string) || '>\"' else 'password = \"' || {HASH} || '\"' end", HASH, "o_orderkey % 2 = 1"),
    "map_to_source": ("EMAIL", "'é mail user' || cast(o_orderkey as string) || '＠example.com today'", "'user' || cast(o_orderkey as string) || '＠example.com'", "true"),
}


def _encoded(expression: str) -> str:
    """``base64(x)`` as DuckDB says it: ``to_base64(encode(x))``."""
    out, at = "", 0
    while (start := expression.find("base64(", at)) >= 0:
        depth, end, quoted = 1, start + 7, False
        while depth:
            c = expression[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            end += 1
        out += expression[at:start] + "to_base64(encode(" + expression[start + 7 : end - 1] + "))"
        at = end
    return out + expression[at:]


def _register(name: str, entity: str, text: str, value: str, where: str) -> None:
    config = ScanConfig(entities=tuple(dict.fromkeys((*DEFAULT_ENTITIES, entity))) if entity == "LICENSE_PLATE" else (entity,))
    if entity == "CUSTOM":
        config = replace(config, custom=(Custom("ticket", pattern=r"TCK-[0-9]{6}", whole_word=True),))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("text"))
        found = scan.scan(texts, "text", ["o_orderkey", "text"], config).where(F.col("entity") == entity)
        return found.select("o_orderkey", "entity", F.expr("substring(text, value_start + 1, value_end - value_start)").alias("value"))

    run.__name__ = name
    run.__doc__ = f"{entity} values planted in a text for each order."
    query(f"select o_orderkey, '{entity}' as entity, {_encoded(value)} as value from orders where {where}")(run)


for _name, _case in CASES.items():
    _register(_name, *_case)


@query("""
with t as (select o_custkey, o_orderkey % 4 as k, 100000000000 + o_orderkey as n from orders)
select o_custkey, count(*)::bigint as bare_numbers from t where k < 2 group by o_custkey
""")
def count_bare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long numbers that no finding claims, by customer: some orders give a plain number, some a number in a word."""
    number = (F.lit(100000000000) + F.col("o_orderkey")).cast("string")
    text = F.when(F.col("o_orderkey") % 4 < 2, F.concat(F.lit("ref "), number, F.lit(" ok"))).otherwise(F.concat(F.lit("ref v"), number))
    texts = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.alias("text"))
    found = scan.scan(texts, "text", ["o_custkey", "o_orderkey"], ScanConfig(entities=("SECRET",)))
    return scan.unclaimed_numbers(texts, "text", ["o_custkey", "o_orderkey"], found).groupBy("o_custkey").agg(F.sum("bare_numbers").alias("bare_numbers"))

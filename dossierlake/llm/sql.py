"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from dossierlake.llm.centroids import SCALE
from dossierlake.llm.url_filter import RULES, SUFFIXES, Reputation

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- 11: Merkle manifest -----------------------------------------------------------------------------------------


def _leaf(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"""


def _tree(name: str, start: str, levels: int) -> list[str]:
    """CTEs name0 (g, i, d) up to name<levels>, and the runs of each level but the last: name<l>r (g, p, ds, n)."""
    out = [f"{name}0 as materialized ({start})"]
    for at in range(levels):
        out.append(f"{name}{at}r as materialized (select g, i // 16 as p, list(d order by i) as ds, any_value(n) as n from (select *, count(*) over (partition by g) as n from {name}{at}) group by g, i // 16)")
        out.append(f"{name}{at + 1} as materialized (select g, p as i, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d from {name}{at}r)")
    return out


def _climb(name: str, tree: str, start: str, levels: int) -> list[str]:
    """CTEs name0 (k, g, i, f, proof) up to name<levels>: the folded digest f and the siblings so far."""
    out = [f"{name}0 as materialized ({start})"]
    for at in range(levels):
        left, right = "array_to_string(r.ds[1:c.i % 16], '')", "array_to_string(r.ds[c.i % 16 + 2:], '')"
        out.append(
            f"""{name}{at + 1} as materialized (select c.k, c.g, c.i // 16 as i, case when r.n = 1 then c.f else sha256({left} || c.f || {right}) end as f,
            case when r.n = 1 then c.proof else c.proof || {left} || {right} end as proof
            from {name}{at} c join {tree}{at}r r on r.g = c.g and r.p = c.i // 16)"""
        )
    return out


def merkle(levels: int = 6, over: int = 4) -> str:
    """For up to 16**levels rows of a source and 16**over sources."""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"leaves as materialized (select doc_id, source, {_leaf('text')} as leaf, case when {CRC} % 5 = 0 then {_leaf(lower)} else {_leaf('text')} end as shown from documents)",
        "sources as materialized (select source, row_number() over (order by source nulls first) - 1 as g from (select distinct source from leaves))",
        "placed as materialized (select row_number() over () as k, doc_id, g, leaf, shown, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from leaves l join sources s on s.source is not distinct from l.source)",
        *_tree("s", "select g, i, leaf as d from placed", levels),
        *_tree("t", f"select 0 as g, g as i, d from s{levels}", over),
        *_climb("c", "s", "select k, g, i, shown as f, '' as proof from placed", levels),
        *_climb("u", "t", f"select k, 0 as g, g as i, f, proof from c{levels}", over),
    ]
    return f"""with {", ".join(ctes)}
    select doc_id, leaf, s.d as subroot, t.d as root, sha256(u.proof) as proof_sha256, u.f as folded_root, u.f = t.d as verified, cast(length(u.proof) // 64 as int) as n_siblings
    from placed p join u{over} u on u.k = p.k join s{levels} s on s.g = p.g cross join t{over} t"""


# --- 12: centroids -----------------------------------------------------------------------------------------------


def centroids(k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:") -> str:
    fine = f"len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}"
    ctes = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q, sha256('{salt}' || coalesce(vec_id::varchar, '')) as h, embedding as e from embeddings where {fine})",
        f"c0 as materialized (select row_number() over (order by h, e) - 1 as c, q from v qualify c < {k})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        ctes.append(f"a{r} as materialized (select r, any_value(vec_id) as vec_id, any_value(q) as q, min(w) as w from (select v.r, v.vec_id, v.q, struct_pack(d := {far}, c := c.c) as w from v, c{r} c) group by r)")
        if r < rounds:
            ctes.append(f"p{r} as materialized (select c, i, (s - ((s % n + n) % n)) // n as m from (select c, i, sum(x)::bigint as s, count(*) as n from (select w.c as c, unnest(range(1, {dim + 1})) as i, unnest(q) as x from a{r}) group by c, i))")
            ctes.append(f"c{r + 1} as materialized (select c.c, coalesce(m.q, c.q) as q from c{r} c left join (select c, list(m order by i) as q from p{r} group by c) m on m.c = c.c)")
    return f"""with {", ".join(ctes)}
    select vec_id, w.c::int as cluster, w.d as distance, sum(w.d) over (partition by w.c)::bigint as cluster_inertia, sum(w.d) over ()::bigint as inertia,
        sha256(array_to_string(c.q, ',')) as centroid_sha256, count(*) over (partition by w.c) as cluster_size from a{rounds} a join c{rounds} c on c.c = a.w.c"""


# --- 13: URL filters ---------------------------------------------------------------------------------------------


def urls(of: Reputation = Reputation()) -> str:
    host, path = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')", "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    listed = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{r.partition('/')[1] + r.partition('/')[2]}')" for v, r in RULES)
    suffixes = ", ".join(f"'{s}'" for s in SUFFIXES)

    def level(name: str, rows: str, parent: str, join: str) -> list[str]:
        """CTE with the posterior of a level's rows (n, bad) under a parent's (up, mean)."""
        return [
            f"{name}_m as materialized (select l.*, p.up as prior, p.mean from {rows} l join {parent} p on {join})",
            f"""{name}_k as materialized (select case when k > 1 and total > k and b + (n0 - 1) * w > 0 and (b - w) / (b + (n0 - 1) * w) > 0
                then least(greatest((1 - (b - w) / (b + (n0 - 1) * w)) / ((b - w) / (b + (n0 - 1) * w)), {of.least}), {of.most}) else {of.most} end::double as m
                from (select count(*) as k, sum(n)::double as total, sum(n * (bad / n - mean) * (bad / n - mean)) / nullif(count(*) - 1, 0) as b,
                sum(n * (bad / n) * (1 - bad / n)) / nullif(sum(n)::double - count(*), 0) as w,
                (sum(n)::double - sum(n::double * n) / nullif(sum(n)::double, 0)) / nullif(count(*) - 1, 0) as n0 from {name}_m))""",
            f"{name} as materialized (select l.*, (bad + m * prior) / (n + m) as up0, m from {name}_m l cross join {name}_k)",
        ]

    ctes = [
        f"u as materialized (select page_id, {host} as host, {path} as path from pages)",
        f"rules(verdict, rule, rule_host, rule_path) as (values {listed})",
        "hosts0 as materialized (select host, count(*) as n, sum(1 - quality)::bigint as bad from u join labels l on l.doc_id = u.page_id where quality is not null group by host)",
        f"""hosts as materialized (select *, case when host = suffix then host else array_to_string(string_split(host, '.')[-(len(string_split(suffix, '.')) + 1):], '.') end as domain from
            (select *, case when array_to_string(string_split(host, '.')[-2:], '.') in ({suffixes}) then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix from hosts0))""",
        "domains as materialized (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by all)",
        "suffixes as materialized (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by suffix)",
        "top as materialized (select coalesce(sum(bad) / nullif(sum(n), 0), 0)::double as up, coalesce(sum(bad) / nullif(sum(n), 0), 0)::double as mean from suffixes)",
        *level("s", "suffixes", "top", "true"),
        *level("d", "domains", "(select suffix, up0 as up, bad / n as mean from s)", "p.suffix = l.suffix"),
        *level("h", "hosts", "(select domain, up0 as up, bad / n as mean from d)", "p.domain = l.domain"),
        f"blocked as materialized (select host from h where up0 - {of.z} * sqrt(up0 * (1 - up0) / (n + m + 1)) > {of.limit})",
        """fits as materialized (select page_id, host, path, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) as f
            from (select distinct page_id, host, path from u) u join rules r on (u.host = r.rule_host or u.host like '%.' || r.rule_host) and starts_with(u.path, r.rule_path) group by all)""",
    ]
    return f"""with {", ".join(ctes)}
    select u.page_id, u.host, u.path, f.f.rule as rule, coalesce(f.f.verdict, case when b.host is not null then 'block' else 'allow' end) as verdict,
        case when f.f.rule is not null then 'rule' else 'reputation' end as method
    from u left join fits f on f.page_id is not distinct from u.page_id and f.host = u.host and f.path = u.path left join blocked b on b.host = u.host"""


ORACLE = {"op11_merkle": merkle(), "op12_centroids": centroids(), "op13_url_filter": urls()}

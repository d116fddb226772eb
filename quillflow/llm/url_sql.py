"""The SQL of the URL filter, with patterns of its own, over any table of pages."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Addresses ``t`` of a table, resolved against its host, path, query and scheme: table (rid, b).
_RESOLVED = r"""
{name}_parts as (
  select *, regexp_extract(t, '^([^?#]*)', 1) tpath, regexp_extract(t, '^[^?#]*([^#]*)', 1) tquery,
    lower(regexp_extract(t, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) said,
    coalesce(nullif(regexp_extract(path, '^(.*/)', 1, 's'), ''), '/') folder
  from {source} where t <> '' and not starts_with(t, '#')),
{name}_kinds as (
  select *, case when said <> '' then said else scheme end scheme2,
    case when regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then substr(t, strpos(t, '://') + 3)
         when said = '' and starts_with(t, '//') then substr(t, 3) end rest,
    case when said <> '' or starts_with(t, '//') or starts_with(t, '?') then null
         when starts_with(t, '/') then tpath else folder || tpath end walk
  from {name}_parts),
{name}_walked as (
  select *, string_split(substr(walk, 2), '/') steps, translate(regexp_extract(rest, '^([^/?#]*)', 1), {LOWER}) rest_host from {name}_kinds),
{name} as (
  select rid, case
    when rest is not null then {SITE(rest_host, scheme2)} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1)
    when said <> '' then null
    when starts_with(t, '?') then host || path || tquery
    when walk is not null then host || '/' || array_to_string(
      list_reduce([[]::varchar[]] || list_transform(steps, lambda x: [x]),
        lambda a, x: case when x[1] = '..' then a[1:greatest(len(a) - 1, 0)] when x[1] = '.' then a else a || x end)
      || case when steps[-1] in ('.', '..') then [''] else []::varchar[] end, '/') || tquery end b
  from {name}_walked)"""

_JUDGED = r"""
with recursive p as (
  select row_number() over () rid, page_id, html, url,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest
  from {PAGES}),
q as (
  select rid, page_id, html, lower(split_part(url, '://', 1)) scheme,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), {LOWER}) host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path,
    coalesce(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '') tail, rest is not null has
  from p),
site as (select rid, html, scheme, {SITE(host, scheme)} host, path, tail from q where has),
rules(suffix, prefix, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hosts as (
  select rid, suffix || prefix as rule, verdict,
    row_number() over (partition by rid order by length(suffix || prefix) desc, length(suffix) desc, verdict) k
  from q join rules on (host = suffix or ends_with(host, '.' || suffix)) and starts_with(path, prefix)),
found as (
  select rid, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script|\z)', '', 'g'),
    '(?i)<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') tags
  from site where html is not null),
tags as (select rid, generate_subscripts(tags, 1) pos, unnest(tags) tag from found),
named as (
  select rid, pos, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) kind,
    list_transform(regexp_extract_all(tag, '([^\s"''>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda n: lower(n)) names,
    list_transform(regexp_extract_all(tag, '([^\s"''>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 2), lambda v: {DECODED}) vals
  from tags),
stated as (
  select rid, pos, kind, vals[list_position(names, 'href')] href, lower(vals[list_position(names, 'rel')]) rel,
    lower(vals[list_position(names, 'http-equiv')]) equiv, vals[list_position(names, 'content')] content
  from named),
bases as (select rid, arg_min(href, pos) t from stated where kind = 'base' and href <> '' group by 1),
asked_bases as (select * from site join bases using (rid)),
{RESOLVE(asked_bases, based)},
grounds as (
  select s.rid, s.host || s.tail node, s.scheme,
    case when b.b is null then s.host else regexp_extract(b.b, '^([^/?#]*)', 1) end host,
    case when b.b is null then s.path else regexp_extract(b.b, '^[^/?#]*([^?#]*)', 1) end path
  from site s left join based b on b.rid = s.rid),
targets as (
  select g.*, t from grounds g join (
    select rid, case when kind = 'link' and list_contains(regexp_split_to_array(rel, '\s+'), 'canonical') then href
      when kind = 'meta' and equiv = 'refresh' then regexp_extract(content, '(?is)^[^;,]*[;,]\s*url\s*=\s*["'']?\s*([^"''\s]+)', 1) end t
    from stated) using (rid) where t is not null),
{RESOLVE(targets, linked)},
e as (select g.node a, l.b from linked l join grounds g using (rid) where l.b is not null),
both_ways as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(a, b) as (select a, a from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
nodes as (
  select distinct b node, regexp_extract(b, '^([^/?#]*)', 1) host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) path from reach),
decided as (
  select node, verdict, row_number() over (partition by node order by length(suffix || prefix) desc, length(suffix) desc, verdict) k
  from nodes join rules on (host = suffix or ends_with(host, '.' || suffix)) and starts_with(path, prefix)),
spread as (
  select r.a node from reach r join decided x on r.b = x.node and x.k = 1
  group by 1 having bool_or(x.verdict = 'block') and not bool_or(x.verdict = 'allow'))
select page_id, q.host, q.path, h.rule,
  coalesce(h.verdict, case when s.node is not null then 'block' end, 'allow') verdict
from q left join hosts h on h.rid = q.rid and h.k = 1
left join site on site.rid = q.rid left join spread s on s.node = site.host || site.tail
"""


def _decoded() -> str:
    """A value without its quotes and outer spaces, with the references that the pages use."""
    text = "case when v[1] in ('\"', '''') then v[2:-2] else v end"
    for reference, said in (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2F;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{reference}', '{said}')"
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def _site(host: str, scheme: str) -> str:
    return f"(case lower({scheme}) when 'http' then regexp_replace({host}, ':80$', '') when 'https' then regexp_replace({host}, ':443$', '') else {host} end)"


def judged(pages: str = "pages") -> str:
    """The verdict of every row of ``pages``, a table or a query in brackets."""
    text = _JUDGED.replace("{PAGES}", pages).replace("{DECODED}", _decoded())
    for source, name in (("asked_bases", "based"), ("targets", "linked")):
        text = text.replace(f"{{RESOLVE({source}, {name})}}", _RESOLVED.replace("{source}", source).replace("{name}", name).strip())
    for host, scheme in (("host", "scheme"), ("rest_host", "scheme2")):
        text = text.replace(f"{{SITE({host}, {scheme})}}", _site(host, scheme))
    return text.replace("{LOWER}", _LOWER)


#: Pages of the table with links between them: each kind of tag and address, to hubs and along
#: chains of at most eight, and to places that rules block and allow.
LINKED_HTML = """
case page_id % 16
  when 0 then '<link rel="canonical" href="http://far' || (page_id % 7) || '.com/en/q?a=1&amp;b=' || (page_id % 5) || '">'
  when 1 then '<base href="http://base.org/es/x/"><link href="y' || page_id || '" rel="nofollow canonical">'
  when 2 then '<link title="a>b" data-rel="no" rel=canonical href=' || chr(39) || 'http://far3.org:80/es/' || page_id || chr(39) || '>'
  when 3 then '<!-- <link rel="canonical" href="http://far.com/en/1"> --><p>none</p>'
  when 4 then '<META http-equiv="Refresh" content="0; URL=http://far1.com/en/q?a=1&#38;b=2">'
  when 5 then '<link rel="canonical" href="http://ok.example.com/en/7' || page_id || '"><link rel="canonical" href="http://far2.com/en/q?a=1&b=3">'
  when 6 then '<link rel="canonical" href="http://chain.io/' || (page_id + 1) || '">'
  when 7 then '<script>var x = "<link rel=canonical href=http://far.com/en/2>"</script>'
  when 8 then '<base href="/sub/"><link rel="canonical" href="../es/./z' || page_id || '?k=1#f">'
  when 9 then '<link rel="canonical-not" href="http://far.com/en/3"><link name="canonical" href="http://far.com/en/4">'
  when 10 then '<link rel="canonical" href="//chain.io:80/' || (page_id - 4 - page_id % 16 + 6) || '">'
  when 11 then '<link rel="canonical" href="http://far1.com/en/q?a=1&#x26;b=2" title="' || repeat('x', 5000) || '">'
  when 12 then '<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="">'
  when 13 then null
  when 14 then '<link href="?z=' || page_id || '" rel="canonical"><meta content="1;url=/en/9" name="x">'
  else html end
"""
LINKED_URL = "case page_id % 16 when 6 then 'http://chain.io/' || page_id when 10 then 'https://chain.io:443/' || (page_id + 2) else url end"
LINKED_PAGES = f"(select page_id, {LINKED_URL} as url, {LINKED_HTML} as html from pages)"

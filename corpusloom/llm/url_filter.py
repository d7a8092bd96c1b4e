"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over the lower-case URL: `*` stands for anything, `^` for a separator
or the end, `||` for the start of the host or of one of its labels, `|` for the start or
the end. `@@` in front makes it an exception. A rule's literal tokens are its runs of
letters, digits and % that must be whole tokens of a URL that matches; the rule is filed
under the one that is rarest over all URLs of the table. A URL's tokens fetch the rules
that are filed under them, and only those are tried as regular expressions. A rule
without such a token would be tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name and pattern of each rule.
RULES: tuple[tuple[str, str], ...] = (
    ("gambling_casino_win", "||casino-win.example."),
    ("gambling_casino", "||casino."),
    ("gambling_poker", "||poker."),
    ("gambling_slots", "||online-slots*^"),
    ("gambling_bet", "||bet-now."),
    ("gambling_path", "/casino/*"),
    ("pharma_pills", "||cheap-pills.example."),
    ("pharma_shop", "||online-pharmacy*^"),
    ("pharma_viagra", "^viagra^"),
    ("pharma_cialis", "^cialis^"),
    ("pharma_no_rx", "/no-prescription/"),
    ("spam_farm", "||spam-farm.example."),
    ("spam_link_farm", "||link-farm."),
    ("spam_free_traffic", "||free-traffic."),
    ("spam_seo_links", "/buy-backlinks^"),
    ("spam_work_home", "/work-from-home/earn*"),
    ("spam_weight_loss", "/lose-weight-fast^"),
    ("adult_host", "||xxx."),
    ("adult_porn", "||porn*^"),
    ("adult_cams", "||live-cams."),
    ("adult_escort", "||escorts."),
    ("adult_tld", ".xxx/"),
    ("adult_path", "/nsfw/"),
    ("malware_crack", "/crack-download^"),
    ("malware_keygen", "/keygen^"),
    ("malware_warez", "||warez."),
    ("malware_serials", "/serials/*.exe|"),
    ("phish_login_verify", "/verify-account/login^"),
    ("phish_bank", "/secure-bank-login^"),
    ("phish_paypal", "||paypal-secure."),
    ("ads_doubleclick", "||doubleclick.net^"),
    ("ads_adserver", "||adserver."),
    ("ads_path", "/adframe."),
    ("ads_banner", "/banner/ads/"),
    ("ads_pop", "/popunder^"),
    ("ads_click", "/clicktrack^"),
    ("track_pixel", "/pixel.gif?"),
    ("track_beacon", "/beacon.js|"),
    ("track_feed_campaign", "?utm_source=feed|"),
    ("track_gclid", "&gclid="),
    ("track_fbclid", "?fbclid="),
    ("system_login", "/wp-login.php"),
    ("system_admin", "/wp-admin/"),
    ("system_cgi", "/cgi-bin/"),
    ("system_cart", "/checkout/cart^"),
    ("system_calendar", "/calendar/*/day^"),
    ("system_print", "/print/view^"),
    ("system_session", "?phpsessid="),
    ("system_sort", "?sort=*&order="),
    ("system_login_form", "/users/sign_in|"),
    ("media_jpg", ".jpg|"),
    ("media_png", ".png|"),
    ("media_mp4", ".mp4|"),
    ("media_zip", ".zip|"),
    ("media_exe", ".exe|"),
    ("media_apk", ".apk|"),
    ("proxy_translate", "||translate.goog^"),
    ("proxy_web", "/browse.php?u=http"),
    ("local_host", "|http://localhost^"),
    ("local_network", "|http://192.168."),
    ("torrent_magnet", "|magnet:?xt="),
    ("torrent_host", "||torrents."),
    ("allow_about", "@@/about-us^"),
    ("allow_archive", "@@||archive.example.org^"),
    ("allow_blog_front", "@@||blog.*/en/1^"),
    ("allow_policy", "@@/privacy-policy^"),
)

TOKEN = re.compile(r"[a-z0-9%]+")
_BOUND = {"||": r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", "|": "^", "": ""}


class Rule:
    """A pattern's name, whether it is an exception, its expression (in the common part of the Python and RE2 dialects), and its whole tokens."""

    __slots__ = ("name", "exception", "expression", "tokens")

    def __init__(self, name: str, pattern: str):
        self.name = name
        body = pattern.lower()
        self.exception = body.startswith("@@")
        body = body[2:] if self.exception else body
        head = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(head) :]
        tail = body.endswith("|")
        body = body[:-1] if tail else body
        if not body.strip("*"):
            raise ValueError(f"rule {name!r} would match every URL")
        self.expression = _BOUND[head] + "".join({"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c, c if c.isalnum() or c in "_%/:=&" else "\\" + c) for c in body) + (r"\z" if tail else "")
        self.tokens = []
        for m in TOKEN.finditer(body):
            before = body[m.start() - 1] if m.start() else "^" if head else "*"
            after = body[m.end()] if m.end() < len(body) else "^" if tail else "*"
            if before != "*" and after != "*":
                self.tokens.append(m.group())

    def compiled(self) -> re.Pattern:
        return re.compile(self.expression.replace(r"\z", r"\Z"), re.ASCII)


def tokens_column(url):
    """The distinct tokens of each URL, as a column."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9%]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """For each of the tokens, in how many rows of urls(url) it occurs. Counts over all rows; what comes back is a number for each of the rules' tokens."""
    wanted = sorted(set(tokens))
    held = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")
    met = urls.select(F.explode(F.array_intersect(tokens_column(F.col("url")), held)).alias("token"))
    found = {r.token: r.n for r in met.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: found.get(t, 0) for t in wanted}


class Index:
    """Rules by their rarest token. always: those without one."""

    def __init__(self, rules: tuple[tuple[str, str], ...], counts: dict[str, int]):
        self.rules = [Rule(*r) for r in rules]
        self.by: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, rule in enumerate(self.rules):
            if rule.tokens:
                self.by.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
            else:
                self.always.append(k)

    def matcher(self):
        """url -> numbers of the rules that match, ascending. Expressions are compiled when first needed."""
        compiled: dict[int, re.Pattern] = {}
        by, always, rules, find = self.by, self.always, self.rules, TOKEN.findall

        def match(url: str) -> list[int]:
            url = url.lower()
            candidates = list(always)
            for t in set(find(url)):
                own = by.get(t)
                if own:
                    candidates += own
            found = []
            for k in candidates:
                if k not in compiled:
                    compiled[k] = rules[k].compiled()
                if compiled[k].search(url):
                    found.append(k)
            return sorted(found)

        return match


def _judge(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = index.matcher()
        for batch in batches:
            verdict, n, names = [], [], []
            for url in batch.column(1).to_pylist():
                found = match(url) if url else []
                verdict.append("none" if not found else "allow" if any(index.rules[k].exception for k in found) else "block")
                n.append(len(found))
                names.append(",".join(sorted(index.rules[k].name for k in found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdict, pa.string()), pa.array(n, pa.int64()), pa.array(names, pa.string())], ["page_id", "verdict", "n_rules", "rules"])

    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row (page_id, verdict, n_rules, rules) for every row of pages; rules are the names of those that match, in order, with commas.

    verdict is allow if an exception matches, else block if a rule does, else none. A null or
    empty url matches nothing. page_id may be null; repeated rows are judged each by itself;
    other columns are not read. URLs of any length are matched whole. An empty table gives
    no rows. Rules of the same name or pattern all count.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    known = {t for r in rules for t in Rule(*r).tokens}
    index = Index(rules, token_counts(rows, known))
    return rows.mapInArrow(_judge(index), "page_id bigint, verdict string, n_rules bigint, rules string")


def keep_allowed(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The rows of pages whose page_id no blocked url has, with all their columns; rows with a null page_id stay."""
    gone = judge(pages, rules).where("verdict = 'block' AND page_id IS NOT NULL").select(F.col("page_id").alias("gone")).distinct()
    return pages.join(gone, pages["page_id"].cast("bigint") == gone["gone"], "left_anti")


def _sql() -> str:
    each = "\n  UNION ALL ".join("SELECT '{}' AS name, {} AS exception, row, page_id FROM urls WHERE regexp_matches(lower(url), '{}')".format(r.name, str(r.exception).lower(), r.expression.replace("'", "''")) for r in (Rule(*x) for x in RULES))
    return f"""
WITH urls AS (SELECT row_number() OVER () AS row, page_id, url FROM pages),
hits AS (
  {each}),
found AS (SELECT row, count(*) AS n, bool_or(exception) AS allowed, string_agg(name, ',' ORDER BY name) AS names FROM hits GROUP BY row)
SELECT page_id, CASE WHEN n IS NULL THEN 'none' WHEN allowed THEN 'allow' ELSE 'block' END AS verdict,
  CAST(coalesce(n, 0) AS BIGINT) AS n_rules, coalesce(names, '') AS rules
FROM urls LEFT JOIN found USING (row)
"""


SQL = _sql()

"""Operator 10: unwanted URLs, by logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenpair.llm._spark import table

BITS, SIZES = 15, (3, 4, 5)
#: The small labelled URL table, combined by labelled_urls(): words of hosts and paths that a corpus does without, and that it wants; and addresses of well-known sites of both kinds.
UNWANTED = "casino-royal lucky-casino bets-online sportsbets bet-now poker-king slots-jackpot win-prize winner-bonus pills-shop viagra-pills diet-pills pharma-cheap cheap-watches cheap-meds adult-video adult-chat xxx-cams porn-tube sex-dating hot-cams spam-mail mega-spam link-farm content-farm seo-links ads-server ad-click track-pixel click-tracker free-iphone free-coins free-spins payday-loan crack-keygen warez-club torrent-crack replica-store".split()
WANTED = "news library science weather garden history museum school travel recipes council journal archive theatre forum docs market sports music health energy bank river mountain physics biology chemistry cooking astronomy economics poetry cinema football cycling hiking photography architecture painting philosophy geography climate ocean forest wildlife parenting software databases university hospital parliament railway village".split()
KNOWN_UNWANTED = (
    "www.bet365.com/casino www.pokerstars.com/poker/tournaments www.888casino.com/promotions 1xbet.com/en/slots www.betfair.com/sport/football-betting www.williamhill.com/vegas www.ladbrokes.com/bonus www.partypoker.com/welcome-bonus stake.com/casino/slots www.bovada.lv/sports "
    "www.draftkings.com/odds/picks www.pornhub.com/video xhamster.com/categories www.xvideos.com/tags www.redtube.com/top chaturbate.com/female-cams onlyfans.com/live stripchat.com/girls www.adultfriendfinder.com/sex-dating www.ashleymadison.com/affair "
    "www.doubleclick.net/click?id=1 ad.360yield.com/pixel adservice.google.com/ddm www.taboola.com/sponsored www.outbrain.com/widget c.statcounter.com/track pixel.quantserve.com/pixel thepiratebay.org/torrent/crack 1337x.to/search/keygen www.skidrowreloaded.com/cracked-games "
    "cheap-viagra-online.biz/order buy-cialis-now.ru/pills weight-loss-miracle.info/free-trial earn-money-fast.club/sign-up replica-rolex-watches.cn/sale instant-payday-loans.biz/apply free-robux-generator.xyz/claim win-iphone-today.top/prize hot-singles-near-you.date/chat lottery-winner-claim.online/bonus"
).split()
KNOWN_WANTED = (
    "en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Goethe fr.wikipedia.org/wiki/Paris es.wikipedia.org/wiki/Madrid www.britannica.com/biography/Ada-Lovelace arxiv.org/abs/1706.03762 docs.python.org/3/library/re.html www.gutenberg.org/ebooks/1342 plato.stanford.edu/entries/kant www.nature.com/articles/d41586 "
    "www.bbc.co.uk/news/science-environment www.theguardian.com/books/reviews www.lemonde.fr/planete www.spiegel.de/wissenschaft elpais.com/cultura www.nytimes.com/section/health www.reuters.com/world/europe apnews.com/hub/climate www.npr.org/sections/education www.smithsonianmag.com/history "
    "www.nasa.gov/missions www.noaa.gov/weather www.who.int/health-topics www.cdc.gov/flu www.gov.uk/register-to-vote www.loc.gov/collections www.europarl.europa.eu/news www.mit.edu/research www.ox.ac.uk/admissions www.uni-heidelberg.de/de/studium "
    "stackoverflow.com/questions/tagged/sql github.com/apache/spark developer.mozilla.org/en-US/docs/Web spark.apache.org/docs/latest www.postgresql.org/docs/current www.rust-lang.org/learn www.seriouseats.com/recipes www.lonelyplanet.com/italy www.imdb.com/title/tt0111161 www.openstreetmap.org/about"
).split()


#: Hosts that tell nothing: they come with either label, with words of either kind in the path.
NEUTRAL = "acme plain corner studio atlas maple harbor stone vertex lumen orbit cedar".split()
LANGUAGES = ("en", "fr", "de", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """Well-known addresses of both kinds; words of either kind as hosts, with paths that don't tell; then the same words in paths, on hosts that don't. Each shape and language of a
    path, sub-domain, ending and neutral host comes with both labels alike."""
    out = [(f"https://{u}", y) for pair in zip(KNOWN_UNWANTED, KNOWN_WANTED) for u, y in zip(pair, (1, 0))]
    shapes = ("/{w}", "/{l}/{w}", "/{w}/{n}", "/{l}/{w}/index.html", "/page/{w}-{n}", "/{n}/{w}.html", "/{l}/{n}/{w}?ref=x", "/{a}/{b}")
    for label, stems in ((1, UNWANTED), (0, WANTED)):
        for k in range(max(len(UNWANTED), len(WANTED))):  # as many rows of either label
            stem = stems[k % len(stems)]
            for j, sub in enumerate(("", "www.", "blog.", "m.")):
                end, lang = ("com", "net", "org")[(k + j) % 3], LANGUAGES[(k + 2 * j) % 4]
                path = (f"/{lang}/{137 * k + 31 * j}", f"/{k}/index.html", f"/page/{k}?ref=x", f"/{lang}/{k}?utm_source=feed")[(k + j) % 4]
                out.append((f"http{'s' * (j % 2)}://{sub}{stem}.example.{end}{path}", label))
                shape = shapes[(k + 2 * j) % len(shapes)]
                path = shape.format(w=stem, a=stem.split("-")[0], b=stem.split("-")[-1], l=lang, n=17 * k + j)
                out.append((f"http{'s' * (j % 2)}://{sub}{NEUTRAL[k % len(NEUTRAL)]}.example.{end}{path}", label))
    return out


def features(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram indices, offsets of the URLs): 3- to 5-grams of the host in lower case, and of the path, in a space of 2^BITS each half."""
    flat, ends = [], [0]
    for url in urls:
        rest = (url or "").lower().split("://", 1)[-1].split("#", 1)[0].split("?", 1)[0]
        host, _, path = rest.partition("/")
        got = []
        for salt, part in ((1, f"^{host}$" if host else ""), (2, f"/{path}$" if path else "")):
            b = np.frombuffer(part.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
            for n in SIZES:
                if len(b) >= n:
                    h = np.full(len(b) - n + 1, salt * 1000 + n, np.uint64)
                    for j in range(n):
                        h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint64(0x100000001B3)
                    got.append((h ^ (h >> np.uint64(33))) & np.uint64((1 << BITS) - 1))
        got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        flat.append(got)
        ends.append(ends[-1] + len(got))
    return np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64), np.array(ends)


def logits(weights: np.ndarray, bias: float, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bias plus the mean-scaled weights of each URL's n-grams: sums by offsets, divided by the root of their number."""
    sums = np.r_[0.0, np.cumsum(weights[index])]
    n = np.diff(ends)
    return bias + (sums[ends[1:]] - sums[ends[:-1]]) / np.sqrt(np.maximum(n, 1))


def train(examples: list[tuple[str | None, int]], ridge: float = 3e-4, rounds: int = 600, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch gradient descent from zero: the same table always gives the same model. No examples: all weights are zero."""
    w, bias = np.zeros(1 << BITS), 0.0
    examples = [(u, y) for u, y in examples if y is not None]
    if not examples:
        return w, bias
    index, ends = features([u for u, _ in examples])
    y, n = np.array([float(v) for _, v in examples]), np.diff(ends)
    row, scale = np.repeat(np.arange(len(y)), n), 1 / np.sqrt(np.maximum(n, 1))
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-logits(w, bias, index, ends))) - y
        w -= rate * (np.bincount(index, (off * scale)[row], len(w)) / len(y) * 8 + ridge * w)
        bias -= rate * off.mean()
    return w, bias


def score(pages: DataFrame, examples: list[tuple[str | None, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, score, unwanted) for each row of pages(page_id, url, ...), repeated rows and rows without page_id included.

    A null url has a null score and isn't unwanted; an empty one has the bias alone. Host and path of any length count whole. The model is
    2^BITS weights, whatever the number of pages; there is no shuffle, and only two columns are read."""
    w, bias = train(labelled_urls() if examples is None else examples)

    def run(batches):
        for batch in batches:
            urls = batch.column(1).to_pylist()
            p = 1 / (1 + np.exp(-logits(w, bias, *features(urls)))) if urls else np.zeros(0)
            none = np.array([u is None for u in urls], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(p.round(6), pa.float64(), mask=none), pa.array((p >= threshold) & ~none)], ["page_id", "url", "score", "unwanted"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, url string, score double, unwanted boolean")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "pages"))


QUERIES, SQL = {"op10_url_filter": op10_url_filter}, {}

"""Per-site extraction rules, as configuration.

Fixed values: the class and id names these sites use. A rule applies when the
page's host ends with its key.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteRule:
    # (selector, least text length, least paragraphs): the first that meets either wins
    preferred: tuple = ()
    # everything from the first match to the end of its parent is dropped
    cuts: tuple = ()
    # dropped anywhere in the main content
    drops: tuple = ()
    # link address parts whose enclosing block is dropped
    drop_links: tuple = ()
    # figure captions are not kept
    no_captions: bool = False
    # image address part that marks a failed extraction
    bad_image: str = ""
    # (least bullet links, words, least words present): page furniture instead of an article
    shell: tuple = ()


_IID = SiteRule(
    preferred=(("article.arti-body", 260, 2), (".arti-body", 260, 2)),
    cuts=(".footer-common-link", ".thm-footer", ".footer-nav", ".footer-sitemap"),
    drops=(
        ".pickup-text-list", ".main-pickup", ".main-ranking", "#_popIn_recommend", ".af_box", ".af_list",
        "[class^='af_']", "[class*=' af_']", "figure.ctms-editor-twitter", ".ctms-editor-twitter",
        "blockquote.twitter-tweet", ".twitter-tweet", "figure.ctms-editor-instagram", ".instagram-media",
        ".recommended-list", ".recommended-ttl", ".share-block", ".sidebox", "article.pickup-content",
        "article.feature-content", "article.ranking-content", "article.side-content",
    ),
    shell=(10, ("人生にゲームをプラスするメディア", "インサイド", "animeanime"), 1),
)

SITE_RULES = {
    "natalie.mu": SiteRule(
        preferred=(("article.NA_article .NA_article_body", 120, 1), (".NA_article_body", 120, 1), ("article.NA_article", 420, 2)),
        cuts=(".NA_article_tag",),
        drops=(
            ".NA_article_embed_article", ".NA_article_tag", ".NA_article_img_link", ".NA_article_data",
            ".NA_article_score", ".NA_article_score-comment",
        ),
    ),
    "animenewsnetwork.com": SiteRule(
        preferred=(
            ("#content-zone .meat", 120, 1), ("#content-zone .KonaBody", 420, 2), ("#content-zone", 420, 2),
            (".KonaBody", 420, 2), (".meat", 120, 1), ("#maincontent .KonaBody", 420, 2), ("#maincontent", 420, 2),
        ),
        cuts=("#social-bookmarks", "#footer"),
        drops=(
            "instaread-player", "[data-user-preferences-action-open]", "#content-preferences",
            "#social-bookmarks", "#footer", ".box[data-topics]",
        ),
        drop_links=("/cms/discuss/",),
        no_captions=True,
        bad_image="/img/spacer.gif",
    ),
    "inside-games.jp": _IID,
    "animeanime.jp": _IID,
    "otakumode.com": SiteRule(
        preferred=(
            ("article.p-article .p-article__text", 140, 1), ("article.p-article .p-article__body", 260, 2),
            ("article.p-article", 520, 3), ("article", 520, 3),
        ),
        cuts=(".p-article__comments", ".p-article__toolbox"),
        drops=(
            ".p-global-header-wrapper", ".p-global-header", ".p-global-nav", ".p-news-nav", ".p-news-categories-nav",
            ".p-article__toolbox", ".p-article__tool-btn", ".p-article__comments", ".p-article__meta",
        ),
        shell=(8, ("tokyo otaku mode", "otapedia", "shop", "gallery", "news", "log in", "sign up", "shopping guide"), 3),
    ),
}

# Containers tried on every site, in order.
CONTAINERS = (
    "article", "[itemprop='articleBody']", ".article-body", ".article__body", ".entry-content", ".post-content",
    ".post-body", ".content__body", ".c-article__body", "main", "#content", "#main", ".content",
)
# Page furniture removed before looking for the article.
FURNITURE = (
    "script", "style", "noscript", "iframe", "svg", "canvas", "nav", "header", "footer", "aside", "form",
    "[role='navigation']", "[role='banner']", "[role='contentinfo']", "[aria-hidden='true']",
    ".share", ".shares", ".social", ".sns", ".comment", ".comments", ".related", ".recommend", ".recommended",
    ".newsletter", ".subscribe", ".breadcrumb", ".breadcrumbs", ".pagination", ".pager", ".adsbygoogle",
    ".advertisement", ".ad", ".ads", ".box[data-topics]",
)
# The same inside the article itself.
INNER_FURNITURE = (
    "nav", "header", "footer", "aside", ".share", ".shares", ".social", ".sns", ".comment", ".comments", ".related",
    ".recommend", ".recommended", ".newsletter", ".subscribe", ".breadcrumb", ".breadcrumbs", ".pagination", ".pager",
    ".ad", ".ads", ".adsbygoogle", ".advertisement", ".af_box", ".af_list",
)
# Words that mark lists of links to other pages.
NOISE_WORDS = (
    "related", "recommended", "recommend", "popular", "ranking", "archive", "archives", "newsletter", "subscribe",
    "follow", "share", "tag", "tags", "category", "categories", "関連記事", "関連", "おすすめ", "人気", "ランキング",
    "タグ", "カテゴリ", "シェア",
)
MORE_NOISE_WORDS = NOISE_WORDS + ("sponsored", "advertisement", "read more", "フォロー", "スポンサー", "広告", "続きを読む")
# Images that only count visitors.
TRACKING_IMAGES = (
    "imgvc.com/i/bf.png", "sync.intentiq.com/profiles_engine", "intentiq.com/profiles_engine",
    "sync.adkernel.com/user-sync", "creativecdn.com/cm-notify", "u.4dex.io/setuid", "doubleclick.net",
    "adservice.google.com", "adsystem.com",
)
# Video hosts whose links are content.
# Host, label, where the address has the video's name, and its watch page.
VIDEO_SITES = (
    ("youtube.com", "YouTube", r"(?:/embed/|[?&]v=)([^/?&#]+)", "https://www.youtube.com/watch?v={}"),
    ("youtu.be", "YouTube", r"youtu\.be/([^/?&#]+)", "https://www.youtube.com/watch?v={}"),
    ("vimeo.com", "Vimeo", r"//player\.vimeo\.com/video/([^/?&#]+)", "https://vimeo.com/{}"),
    ("nicovideo.jp", "Niconico", "", ""),
    ("nico.ms", "Niconico", "", ""),
    ("bilibili.com", "Bilibili", "", ""),
    ("b23.tv", "Bilibili", "", ""),
    ("twitch.tv", "Twitch", "", ""),
)
VIDEO_HOSTS = tuple(site[0] for site in VIDEO_SITES)


def rule_for(host: str, rules: dict = SITE_RULES) -> SiteRule:
    return next((r for key, r in rules.items() if host.endswith(key)), SiteRule())

"""Settings and rules. Every clock is a parameter; nothing here reads the wall clock."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values -------------------------------------------------------------
# Item categories in display order, and their labels per output language.
CATEGORIES = ("anime", "game", "goods", "seiyuu")
CATEGORY_LABELS = {
    "zh": {"anime": "动画", "game": "游戏联动", "goods": "周边手办", "seiyuu": "声优活动"},
    "ja": {"anime": "アニメ", "game": "ゲーム/コラボ", "goods": "グッズ/フィギュア", "seiyuu": "声優/イベント"},
}
# Words accepted for a category in a query.
CATEGORY_ALIASES = {
    "anime": "anime", "动画": "anime", "アニメ": "anime",
    "game": "game", "游戏": "game", "ゲーム": "game",
    "goods": "goods", "周边": "goods", "周邊": "goods", "グッズ": "goods",
    "seiyuu": "seiyuu", "声优": "seiyuu", "声優": "seiyuu",
}
# Tag rules in priority order: (tag, pattern). Matching ignores case.
# Words that need a boundary use an ASCII boundary, so `PV` is found between kanji.
TAG_RULES = (
    ("PV/预告", r"(?<![0-9A-Za-z_])PV(?![0-9A-Za-z_])|ティザー|特報|予告|trailer|teaser"),
    ("定档/上映", r"放送|配信|公開|上映|解禁|決定|start|premiere|release date"),
    ("联动/コラボ", r"コラボ|collab|collaboration|联动"),
    ("手办/フィギュア", r"フィギュア|figure|手办|ねんどろいど|nendoroid"),
    ("活动/イベント", r"イベント|event|live|concert|フェス"),
    ("声优/キャスト", r"声優|CV|出演|cast|voice actor"),
)
# Tag given to an item no rule matches, by category.
DEFAULT_TAGS = {"game": "游戏", "goods": "周边", "seiyuu": "声优"}
DEFAULT_TAG = "资讯"
# Tokens ignored by the duplicate key.
NOISE_TOKENS = ("新作", "特報")
# Query parameters that only track visitors (besides everything starting with utm_).
TRACKING_KEYS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "yclid")
# Image hosts that refuse hot-linking, and the public image proxies.
BLOCKED_COVER_HOSTS = ("www.animenewsnetwork.com",)
IMAGE_PROXY_HOST = "images.weserv.nl"
# ---------------------------------------------------------------------------

OUTPUT_LANGS = ("zh", "ja")


@dataclass(frozen=True)
class Settings:
    """Thresholds of one run. Limits on counts are 0, for none, unless a caller sets them."""

    days: int = 30
    snapshot_limit: int = 0
    history_max: int = 0
    stale_hours: int = 72
    drop_min_prev: int = 12
    drop_min_keep: int = 3
    drop_ratio: float = 0.15
    enrich_max: int = 0
    enrich_per_source: int = 0
    cover_miss_hours: int = 72
    preview_miss_hours: int = 24
    preview_min_len: int = 90
    preview_max_len: int = 420
    cover_cache_max: int = 260
    translate_max_posts: int = 0
    search_limit: int = 1500
    fresh_hours: int = 6
    tag_rules: tuple = field(default=TAG_RULES)

    @staticmethod
    def from_mapping(values: dict) -> "Settings":
        """Reads overrides as text; a value that does not parse or is out of range keeps the default."""
        base = Settings()
        out = {}
        for name, default in base.__dict__.items():
            raw = values.get(name)
            if raw is None or isinstance(default, tuple):
                continue
            try:
                number = float(str(raw).strip())
            except ValueError:
                continue
            if number != number or number in (float("inf"), float("-inf")) or number < 0:
                continue
            if isinstance(default, float):
                if number <= 1:
                    out[name] = number
            else:
                out[name] = int(number)
        return Settings(**out)

"""What a user says of a stall, as columns: tags, hosts, time, profile and action; and the endpoints that belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags in order and the wording that sets them.
TAG_TERMS = {
    "video": ("视频", "直播", "播放器", "video", "stream"), "web": ("网页", "网站", "页面", "浏览器", "web", "http"),
    "download": ("下载", "文件", "下载速度", "download"), "game": ("游戏", "对战", "game", "fps"), "meeting": ("会议", "通话", "语音", "视频会议", "zoom", "teams"),
    "dns": ("dns", "解析", "域名"), "latency": ("延迟", "延时", "ping", "响应慢", "慢"), "buffering": ("卡顿", "缓冲", "转圈", "加载", "停顿", "黑屏"),
    "disconnect": ("断流", "断开", "掉线", "重连", "连接失败"), "login": ("登录", "登陆", "认证", "鉴权", "账号", "signin", "sign in", "login"),
    "connect": ("无法连接", "连不上", "连接超时", "connect"),
}
#: Profiles, the wording that names them, the domains that are theirs.
PROFILES = {"playstation": (("ps5", "ps4", "playstation", "psn"), ("playstation.net", "playstation.com", "sonyentertainmentnetwork.com"))}
#: Actions by the tag that decides, first one first; texts that say nothing.
ACTIONS = (("login", "login"), ("video", "play"), ("download", "download"), ("connect", "connect"))
BLANK = ("请对所选报文进行通用卡顿分析", "请对所选报文进行通用分析")
#: A host name, a time with its unit.
HOST = r"(?:https?://)?\b((?:[a-z0-9-]+\.)+[a-z]{2,63})\b"
TIME = r"([0-9]+(?:\.[0-9]+)?)\s*(秒|s|分钟|min)(?:左右|附近|后)?"
MOST_SIGNS, MOST_HOSTS, MOST_ENDPOINTS = 500, 8, 32


def parsed(text: Column) -> Column:
    """struct(provided, tags, specificity, time_offset_seconds, hosts, profiles, action) of a description; null is empty."""
    plain = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, MOST_SIGNS)
    said = F.when(plain.isin(*BLANK), "").otherwise(plain)

    def from_lower(lowered: Column) -> Column:
        named = [F.when(_any(lowered, terms), tag) for tag, terms in TAG_TERMS.items()]
        hosts = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(HOST), F.lit(1)))), 1, MOST_HOSTS)
        tags = F.array_compact(F.array(*named))
        profiles = F.array_compact(F.array(*[F.when(_any(lowered, terms), name) for name, (terms, _) in PROFILES.items()]))
        action = F.lit("general")
        for tag, name in reversed(ACTIONS):
            action = F.when(F.array_contains(tags, tag), name).otherwise(action)
        # a host says that it is about the web, but comes last
        whole = F.when((F.size(hosts) > 0) & ~F.array_contains(tags, "web"), F.concat(tags, F.array(F.lit("web")))).otherwise(tags)
        number, unit = F.nullif(F.regexp_extract(lowered, TIME, 1), F.lit("")).cast("double"), F.regexp_extract(lowered, TIME, 2)
        return F.struct(
            (lowered != "").alias("provided"), whole.alias("tags"), F.when(F.size(whole) > 0, "specific").otherwise("generic").alias("specificity"),
            (number * F.when(unit.isin("分钟", "min"), 60.0).otherwise(1.0)).alias("time_offset_seconds"), hosts.alias("hosts"), profiles.alias("profiles"), action.alias("action"),
        )

    return F.get(F.transform(F.array(F.lower(said)), from_lower), F.lit(0))


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def observed_names(*sources: DataFrame) -> DataFrame:
    """(host, ip): the distinct names of several protocol sources (host, ip), blank ones left out."""
    rows = sources[0].select("host", "ip")
    for source in sources[1:]:
        rows = rows.unionByName(source.select("host", "ip"))
    return rows.where("coalesce(host, '') not in ('', 'None')").distinct()


def endpoints_of(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """The endpoint rows (ip, ...) whose address one of the names has."""
    return endpoints.join(names.where("ip is not null").select("ip").distinct(), "ip", "left_semi")


def asked_endpoints(endpoints: DataFrame, key: str, names: str, asked: Column, most: int = MOST_ENDPOINTS) -> DataFrame:
    """(key, matched): endpoints one of whose ``names`` (array) was asked for, the first ``most`` by key; matched sorted."""
    matched = F.array_sort(F.array_intersect(F.array_distinct(F.transform(names, lambda x: F.lower(x))), asked))
    return endpoints.select(key, matched.alias("matched")).where(F.size("matched") > 0).orderBy(key).limit(most)

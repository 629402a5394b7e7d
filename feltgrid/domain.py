"""Domain constants, thresholds and schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: must equal the published data set's conventions -------------------------

# Order matters: ties are broken in favour of the earlier emotion.
EMOTIONS = ["joy", "sadness", "anger", "fear", "surprise", "neutral"]
EMOTION_LABELS = {
    "joy": "喜悦", "sadness": "悲伤", "anger": "愤怒",
    "fear": "恐惧", "surprise": "惊讶", "neutral": "中性",
}
BENCHMARK_LABELS = {
    "happy": "喜悦", "angry": "愤怒", "sad": "悲伤",
    "fear": "恐惧", "surprise": "惊讶", "neutral": "中性",
}

PROVINCES = [
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北",
    "湖南", "广东", "广西", "海南", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆", "内蒙古", "香港", "澳门", "台湾",
]
UNKNOWN_PROVINCE = "未知"
NOISE_PROVINCES = ["", "未知", "其他", "海外", "null", "none", "nan"]
PROVINCE_SUFFIXES = ["维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "特别行政区", "省", "市"]

POST_MONTHS = [
    "2019-12", "2020-01", "2020-02", "2020-03", "2020-04", "2020-05", "2020-06", "2020-07", "2020-08",
    "2020-09", "2020-10", "2020-11", "2020-12",
]
MONTH_TARGETS = {
    "2019-12": 2000,
    "2020-01": 10000,
    "2020-02": 10000,
    "2020-03": 10000,
    "2020-04": 10000,
    "2020-05": 7000,
    "2020-06": 7000,
    "2020-07": 7000,
    "2020-08": 7000,
    "2020-09": 7000,
    "2020-10": 7000,
    "2020-11": 7000,
    "2020-12": 7000,
}

MIN_ZH_CHARS = 10
RAW_TEXT_LENGTH = 500
MIN_POSTS_RELIABLE = 30
LOW_SAMPLE_POSTS = 10
ANOMALY_EMOTIONS = ["fear", "anger", "joy"]
Z_THRESHOLD = 2.5
ROLLING_WINDOW = 4
ROLLING_MIN_ROWS = 2
MIN_CLUSTER_POSTS = 50
MIN_MONTHLY_CLUSTER_POSTS = 20
MONTHLY_CLUSTERS = 3
MIN_POSTS_PER_KEYWORD_WEEK = 50
MAX_TERMS = 8000
MAX_DF = 0.85
KEYWORDS_PER_WEEK = 80
KEYWORDS_PER_LIST = 30
SURGE_RATIO = 2.0
EMOTION_ATTRIBUTION_MEAN = 0.05
SWEEP_CAPS = [25, 30, 35, 40, 45, 50, 60, 70]
SCORE_BATCH = 30
SCORE_TRIES = 3
SUM_TOLERANCE = 0.03
SUM_VALID_TOLERANCE = 0.05

POS_KEEP = ["n", "nr", "ns", "nt", "nz", "v", "vn", "a", "an", "i", "l"]

# Fixed values.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你",
    "会", "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些", "什么", "怎么", "如何", "为什么", "因为", "所以",
    "但是", "虽然", "然而", "而且", "或者", "如果", "可以", "这个", "那个", "哪个", "这样", "那样", "怎样", "转发", "微博", "视频", "网页",
    "链接", "展开", "全文", "分享", "图片", "评论", "点赞", "回复", "http", "https", "www", "com", "的了", "不是", "知道", "还是",
    "时候", "已经", "可能", "应该", "需要", "希望", "觉得", "真的", "一下", "一些", "一样", "一直", "一定", "其实", "然后", "现在", "今天",
    "昨天", "明天", "大家", "出来", "起来", "下来", "只是", "这么", "那么", "多么", "这里", "那里", "这些", "那些", "这种", "那种", "每个",
    "某个", "任何", "所有", "全部", "之外", "之间", "之前", "之后", "以上", "以下", "以来", "以及", "以前", "以后", "除了", "对于", "关于",
    "通过", "进行", "实现", "认为", "能够", "必须", "而是", "就是", "也是", "都是", "只有", "只要", "除非", "无论",
]
# Fixed values.
NOISE_WORDS = [
    "转发", "微博", "视频", "网页", "链接", "展开", "全文", "分享", "图片", "评论", "点赞", "回复", "http", "https", "com", "cn",
    "html", "shtml", "超话", "话题", "热搜", "头条", "新闻", "资讯", "关注", "粉丝", "博主", "网友", "评论区", "私信", "消息", "通知",
    "主页", "个人", "秒拍", "秒拍视频", "酷燃", "微博视频", "微博故事", "微博问答", "抽奖", "中奖", "红包", "福利", "活动", "免费", "赠送", "领取",
    "理由", "转发理由", "转发微博", "原图", "查看", "大图", "小图",
]

# --- Schemas --------------------------------------------------------------------------------


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


POST_COLUMNS = ["_id", "user_id", "created_at", "content"]
USER_COLUMNS = ["user_id", "province"]
BENCHMARK_COLUMNS = ["id", "content", "label"]

MINI_SCHEMA = T.StructType(
    _strings("post_id", "user_id", "created_at", "date_week", "date_month", "province",
             "city", "gender", "content_clean", "content_raw")
    + [T.StructField("word_count", T.IntegerType())]
)
LABELLED_SCHEMA = T.StructType(
    MINI_SCHEMA.fields
    + [T.StructField(e, T.DoubleType()) for e in EMOTIONS]
    + _strings("label_status", "label_model", "prompt_version")
)
LABELLED_REQUIRED = ["post_id", "date_week", "date_month", "province", "word_count", *EMOTIONS]
SCORING_REQUIRED = ["post_id", "date_week", "date_month", "province", "content_clean", "word_count"]
CLUSTER_FEATURES = [f"{e}_mean_all" for e in EMOTIONS] + [
    "emotional_intensity_mean", "fear_variance", "joy_variance",
]
MONTHLY_FEATURES = [f"{e}_mean" for e in EMOTIONS]

"""The prompt that asks for a translation of a video's subtitles, as one row per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions import text as tx
from captionforge.schema import LANGUAGES
from captionforge.sources.srt import entry

# The words of the prompt.
SOURCE_NAMES = {"chi_sim": "Tiếng Trung Giản Thể", "chi_tra": "Tiếng Trung Phồn Thể", "eng": "Tiếng Anh", "jpn": "Tiếng Nhật", "kor": "Tiếng Hàn", "vie": "Tiếng Việt"}
ANCIENT = ["宗", "仙", "修", "道", "师", "宗门", "长老", "弟子", "师兄", "师姐"]
GENRES = {"ancient": "phim cổ trang/tu tiên Trung Quốc (donghua)", "chinese": "phim hoạt hình Trung Quốc (donghua)", "jpn": "anime Nhật Bản", "kor": "phim hoạt hình Hàn Quốc", "other": "phim hoạt hình"}
STYLES = {"ancient": "Cổ điển, trang trọng, phù hợp bối cảnh tu tiên/võ hiệp", "anime": "Tự nhiên, trẻ trung, phù hợp văn hóa Nhật Bản", "other": "Tự nhiên, dễ hiểu, phù hợp đối tượng khán giả"}
RULE = "=" * 50
HEAD = """# NHIỆM VỤ DỊCH PHỤ ĐỀ

Bạn là dịch giả phụ đề chuyên nghiệp {genre}.
Hãy dịch phụ đề sau từ **{source}** sang **Tiếng Việt**.

## YÊU CẦU BẮT BUỘC:

📋 **CẤU TRÚC:**
  • Giữ NGUYÊN số thứ tự subtitle
  • Giữ NGUYÊN timestamp (00:00:00,000 --> 00:00:00,000)
  • CHỈ dịch phần TEXT, không chỉnh sửa gì khác

📝 **NỘI DUNG:**
  • Văn phong: {style}
  • Xưng hô: Tự nhiên, nhất quán, phù hợp ngữ cảnh
  • Thuật ngữ: Giữ tên riêng, không phiên âm nếu không cần
  • Độ dài: Tương đương bản gốc, không quá dài

✅ **FORMAT OUTPUT:**
  • Xuất ĐÚNG format SRT
  • Mỗi subtitle cách nhau 1 dòng trống
  • KHÔNG thêm giải thích, chú thích, markdown
  • KHÔNG tự ý gộp hoặc tách subtitle

## VÍ DỤ FORMAT:
```
1
00:00:01,000 --> 00:00:03,000
Văn bản đã dịch dòng 1

2
00:00:03,500 --> 00:00:06,000
Văn bản đã dịch dòng 2
```

"""
LONG = """## LƯU Ý:
  • Đây là phụ đề dài ({n} entries)
  • Giữ nhịp độ câu chuyện mạch lạc
  • Chú ý ngữ cảnh trước/sau để dịch chính xác

"""
BODY, TAIL = f"{RULE}\nPHỤ ĐỀ CẦN DỊCH:\n{RULE}\n\n", f"{RULE}\nHẾT PHỤ ĐỀ\n{RULE}\n"
MANY, LARGE = 50, 100_000


def genre_of(language: str, ancient: Column) -> Column:
    """ancient: whether a video's texts have words of old tales."""
    if language.startswith("chi"):
        return F.when(ancient, GENRES["ancient"]).otherwise(GENRES["chinese"])
    return F.lit(GENRES.get(language, GENRES["other"]))


def style_of(genre: Column) -> Column:
    return F.when(genre.contains("cổ trang") | genre.contains("tu tiên"), STYLES["ancient"]).when(genre.contains("anime"), STYLES["anime"]).otherwise(STYLES["other"])


def has_ancient(text: Column | str) -> Column:
    return tx.filled(text).rlike("|".join(ANCIENT))


def genres(subtitles: DataFrame, language: str) -> DataFrame:
    """(video_id, genre, style)"""
    found = subtitles.groupBy("video_id").agg(F.bool_or(has_ancient("text")).alias("_a")).withColumn("genre", genre_of(language, F.col("_a")))
    return found.select("video_id", "genre", style_of(F.col("genre")).alias("style"))


def prompts(subtitles: DataFrame, language: str = "chi_sim") -> DataFrame:
    """(video_id, prompt): head, a note for many cues, the cues as SRT by start, tail."""
    if language not in {n for n, _ in LANGUAGES.values()}:
        language = "chi_sim"
    cue = F.struct(F.col("start_ms"), F.col("idx"), entry().alias("e"))
    per = subtitles.groupBy("video_id").agg(F.array_sort(F.collect_list(cue)).alias("_c"), F.bool_or(has_ancient("text")).alias("_a"))
    genre = genre_of(language, F.col("_a"))
    before, rest = HEAD.replace("{source}", SOURCE_NAMES[language]).split("{genre}")
    middle, after = rest.split("{style}")
    first, last = LONG.split("{n}")
    note = F.when(F.size("_c") > MANY, F.concat(F.lit(first), F.size("_c").cast("string"), F.lit(last))).otherwise("")
    body = F.concat(F.array_join(F.transform("_c", lambda x: x["e"]), "\n"), F.lit("\n"))
    return per.select("video_id", F.concat(F.lit(before), genre, F.lit(middle), style_of(genre), F.lit(after), note, F.lit(BODY), body, F.lit(TAIL)).alias("prompt"))


def prompt_statistics(made: DataFrame) -> DataFrame:
    """(video_id, chars, lines, warned)"""
    return made.select("video_id", F.length("prompt").alias("chars"), F.size(F.split("prompt", "\n")).alias("lines"), (F.length("prompt") > LARGE).alias("warned"))

"""Rule tables for release names and file lists: data only.

Patterns are written in the common part of the RE2 and Java dialects, without look-around, with the end of the text as $; they are matched without regard
to case unless the comment says otherwise. The order is the order of precedence.
"""

from __future__ import annotations

# Every table in this module must equal that of the catalogue whose results are to be matched; each is marked.

# Fixed value.
#: Group 1 is the season, group 2, where there is one, the episode.
SEASON_EPISODE = [
    r"S(\d{1,2})E(\d{1,3})(?:-E?(\d{1,3}))?",
    r"S(\d{1,2})\s+E(\d{1,3})",
    r"(\d{1,2})x(\d{2,3})(?:-(\d{2,3}))?",
    r"Season[\s._]?(\d{1,2})[\s._-]+Episode[\s._]?(\d{1,3})",
    r"Temp(?:orada)?[\s._]?(\d{1,2})[\s._-]*(?:Cap[\s._]?(\d{1,3}))?",
    r"Season[\s._]?(\d{1,2})(?:[\s._-]|$)",
    r"S(\d{1,2})(?:[\s._-]Complete)?(?:[\s._-]|$)",
]
# Fixed value.
#: Where a title ends that no season pattern cuts.
EPISODE_ONLY = [
    r"Episode[\s._]?(\d{1,3})",
    r"[\s._-]E(\d{1,3})(?:[\s._-]|$)",
    r"Cap[\s._]?(\d{1,3})(?:[\s._-]|$)",
]
# Fixed value.
RESOLUTION = [
    ("2160p", r"[\s._-](2160p|4k|uhd)(?:[\s._-]|$)"),
    ("1080p", r"[\s._-](1080p|1080i|fhd)(?:[\s._-]|$)"),
    ("720p", r"[\s._-](720p|720i)(?:[\s._-]|$)"),
    ("576p", r"[\s._-](576p|576i)(?:[\s._-]|$)"),
    ("480p", r"[\s._-](480p|480i|sd)(?:[\s._-]|$)"),
]
# Fixed value.
SOURCE = [
    ("bluray", r"[\s._-](BluRay|Blu-?Ray|BDRip|BDRemux|BRip|BRRip)(?:[\s._-]|$)"),
    ("web-dl", r"[\s._-](WEB-?DL|WEBDL)(?:[\s._-]|$)"),
    ("webrip", r"[\s._-](WEBRip|WEB-?Rip)(?:[\s._-]|$)"),
    ("hdtv", r"[\s._-](HDTV|HD-?TV)(?:[\s._-]|$)"),
    ("dvdrip", r"[\s._-](DVDRip|DVD-?Rip|DVDR)(?:[\s._-]|$)"),
    ("dvd", r"[\s._-]DVD(?:[\s._-]|$)"),
    ("sdtv", r"[\s._-](SDTV|DSR|PDTV)(?:[\s._-]|$)"),
    ("dtheater", r"[\s._-]DTheater(?:[\s._-]|$)"),
]
# Fixed value.
CODEC = [
    ("av1", r"[\s._-]AV1(?:[\s._-]|$)"),
    ("hevc", r"[\s._-](HEVC|H\.?265|x265)(?:[\s._-]|$)"),
    ("h265", r"[\s._-](H\.?265|x265|HEVC)(?:[\s._-]|$)"),
    ("h264", r"[\s._-](H\.?264|x264|AVC)(?:[\s._-]|$)"),
    ("vp9", r"[\s._-]VP9(?:[\s._-]|$)"),
    ("xvid", r"[\s._-]XviD(?:[\s._-]|$)"),
    ("divx", r"[\s._-]DivX(?:[\s._-]|$)"),
    ("mpeg2", r"[\s._-]MPEG-?2(?:[\s._-]|$)"),
]
# Fixed value.
AUDIO = [
    ("atmos", r"[\s._-]Atmos(?:[\s._-]|$)"),
    ("truehd", r"[\s._-]TrueHD(?:[\s._-]|$)"),
    ("dts-ma", r"[\s._-](DTS-?HD[\s._-]?MA|DTSMA)(?:[\s._-]|$)"),
    ("dts-hd", r"[\s._-](DTS-?HD|DTSHD)(?:[\s._-]|$)"),
    ("dts-x", r"[\s._-](DTS[\s._-]?X|DTSX)(?:[\s._-]|$)"),
    ("dts", r"[\s._-]DTS(?:[\s._-]|$)"),
    ("ddp5.1", r"[\s._-](DDP5\.?1|DDP\.?5\.?1|DD\+5\.?1)(?:[\s._-]|$)"),
    ("dd5.1", r"[\s._-](DD5\.?1|DD5|DD\.?5\.?1|DolbyDigital5\.?1)(?:[\s._-]|$)"),
    ("ac3", r"[\s._-]AC-?3(?:[\s._-]|$)"),
    ("aac", r"[\s._-]AAC(?:[\s._-]|$)"),
    ("flac", r"[\s._-]FLAC(?:[\s._-]|$)"),
    ("lpcm", r"[\s._-]LPCM(?:[\s._-]|$)"),
]
# Fixed value.
#: The bare tag of the fourth rule also stands for Dolby Vision.
HDR = [
    ("dolby-vision", r"[\s._-](Dolby[\s._-]?Vision|DoVi)(?:[\s._-]|$)"),
    ("hdr10+", r"[\s._-]HDR10\+(?:[\s._-]|$)"),
    ("hdr10", r"[\s._-]HDR10(?:[\s._-]|$)"),
    ("dolby-vision", r"[\s._-]DV(?:[\s._-]|$)"),
    ("hdr", r"[\s._-]HDR(?:[\s._-]|$)"),
    ("bt2020", r"[\s._-]BT\.?2020(?:[\s._-]|$)"),
    ("hybrid", r"[\s._-]Hybrid(?:[\s._-]|$)"),
]
# Fixed value.
YEAR_IN_PARENTHESES = r"\((\d{4})\)"
# Fixed value.
YEAR = r"[\s._-](\d{4})(?:[\s._-]|$)"
# Fixed value.
REMUX = r"[\s._-](REMUX|Remux)(?:[\s._-]|$)"
# Fixed value.
GROUP = r"[\s._-]([A-Za-z][A-Za-z0-9]{1,19})$"
# Fixed value.
SUBGROUP = r"^\[([^\]]+)\]"
# Fixed value.
ANIME_EPISODE = r"[\s._-](\d{2,4})(?:v\d)?(?:[\s._\[(]|$)"
# Fixed value.
IMDB_ID = r"(tt\d{7,9})"
# Fixed value.
ANIME = [
    r"^\[[^\]]+\]\s*[^\[]+\s*[\s._-]\d{2,4}(?:v\d)?(?:[\s._\[(]|$)",
    r"\[.*?(?:fansub|subs?|anime)\]",
    r"[\s._-](Hi10P|Hi10|Hi444PP)[\s._-]",
    r"[\s._-](Dual[\s._-]?Audio)[\s._-]",
]
# Fixed value.
TV = [
    r"S\d{1,2}E\d{1,3}",
    r"Season[\s._]?\d{1,2}",
    r"Complete[\s._-]?Series",
    r"\d{1,2}x\d{2,3}",
    r"Episode[\s._]?\d{1,3}",
    r"Temp(?:orada)?[\s._]?\d{1,2}",
    r"Cap[\s._]?\d{1,3}",
]
# Fixed value.
MOVIE = [
    r"\(\d{4}\).*(?:480p|720p|1080p|2160p|4K|UHD)",
    r"(?:480p|720p|1080p|2160p|4K|UHD).*tt\d{7,9}",
]
# Fixed value.
#: Tags that end a title; separators stand before, and any tail of tag characters goes with them.
TITLE_TAGS = (
    r"480p|720p|1080p|1080i|2160p|4k|uhd|fhd|sd|bluray|blu-?ray|web-?dl|webdl|webrip|web|webmux|hdtv|dvdrip|bdrip|"
    r"brrip|brip|bdremux|remux|h\.?264|h\.?265|x264|x265|hevc|av1|xvid|divx|mpeg-?2|aac|ac-?3|dts-?hd|dts-?ma|dts|"
    r"ddp5\.?1|dd5\.?1|dd|atmos|truehd|hdr10\+|hdr10|hdr|dv|dolby|nf|amzn|hmax|dsnp|atvp|pmtp|cr|bili|dts[\s._-]?x|"
    r"dts[\s._-]?hd[\s._-]?ma|dolby[\s._-]?vision|dual[\s._-]?audio|multi|repack|proper|extended|unrated|"
    r"directors?[\s._-]?cut|open[\s._-]?matte|imax|theatrical|internal|ita|eng|fra|fre|french|spa|spanish|ger|german|"
    r"rus|russian|kor|korean|jpn|japanese|chi|chinese|hindi|por|portuguese|dub|dubbed|subbed|subs?|msubs|"
    r"multi[\s._-]?subs?|vostfr|castellano|dual|10bit|8bit|flac|lpcm|eac3|ddp|aac2\.0|h\.?264|h\.?265"
)
# Fixed value.
TITLE_TAIL = rf"[\s._-]+(?:{TITLE_TAGS})[\s._\w\-\+\~]*$"
# Fixed value.
#: Site names before a title. Only the first is matched without regard to case.
WATERMARKS = [r"^(?:www\.)\S+\.\S+\s+[-–—]\s+", r"^[^\s@]+@[^\s@]+@", r"^[^\s@]+\.(?:com|net|org|cc|io|me|xyz|top)@"]
# Fixed value.
VIDEO_EXTENSIONS = [
    ".mkv", ".mp4", ".avi", ".wmv", ".ts", ".m2ts", ".mov", ".m4v", ".webm", ".flv", ".mpg", ".mpeg", ".vob", ".ogv",
]
# Fixed value.
#: Archives, programs, mobile packages, disk images, libraries, documents, game data, links.
JUNK_EXTENSIONS = [
    ".rar", ".zip", ".7z", ".tar", ".gz", ".bz2", ".xz", ".zst", ".cab", ".ace", ".exe", ".msi", ".bat", ".cmd",
    ".com", ".scr", ".pif", ".ps1", ".sh", ".apk", ".ipa", ".xapk", ".aab", ".iso", ".img", ".dmg", ".vhd", ".vmdk",
    ".qcow2", ".bin", ".cue", ".nrg", ".mdf", ".mds", ".dll", ".so", ".dylib", ".sys", ".drv", ".class", ".jar",
    ".war", ".deb", ".rpm", ".pkg", ".snap", ".appimage", ".flatpak", ".pdf", ".doc", ".docx", ".epub", ".mobi",
    ".azw3", ".cbr", ".cbz", ".xls", ".xlsx", ".ppt", ".pptx", ".pak", ".vpk", ".wad", ".bsp", ".unity3d", ".assets",
    ".dat", ".torrent", ".lnk",
]
# Fixed value.
AUDIO_EXTENSIONS = [
    ".mp3", ".flac", ".ogg", ".wav", ".m4a", ".opus", ".wma", ".aac", ".ape", ".alac",
]
# Fixed value.
SUBTITLE_EXTENSIONS = [
    ".srt", ".ass", ".ssa", ".sub", ".idx", ".sup",
]
# Fixed value.
JUNK_NAME = [
    r"[\s._-](crack|keygen|patch|serial|activat|loader)[\s._-]",
    r"[\s._-](portable|repack|setup|install)[\s._-]",
    r"\b(v\d+\.\d+|x86|x64|x86_64|amd64|arm64)\b",
    r"[\s._-](apk|android|ios)[\s._-]",
    r"(windows|win7|win10|win11|macos|linux)[\s._-]",
    r"[\s._-](nulled|cracked|warez|scene)[\s._-]",
    r"(adobe|autodesk|microsoft|office)\s+(20\d{2}|cs\d|cc)",
    r"(?:^|[\s._\[-])(FLAC|MP3|320kbps|V0|CBR|VBR|WEB-FLAC|Lossless|Hi-?Res|24bit|16bit|44\.1kHz|48kHz|96kHz|192kHz)(?:[\s._\]-]|$)",
    r"(?:^|[\s._\[-])(Discography|Discografia|Mixtape|Greatest\.?Hits|Best\.?Of|Live\.?Album)(?:[\s._\]-]|$)",
]
# Fixed value.
#: Names that look like anime are not held against the first two.
ADULT = [
    r"(?:^|[\s._\[@])([A-Z0-9]{2,10})-(\d{3,5})(?:-?[A-Z])?(?:[\s._\]@]|$)",
    r"\.(?:com|net|org|cc|io|me|xyz|top)@([A-Z0-9]{2,10})-(\d{3,5})(?:-?[A-Z])?(?:[\s._\]@]|$)",
    r"(?:^|[\s._-])(無修正|中出し|潮吹き|痴女|素人|熟女|巨乳|美乳|爆乳|淫乱|変態|近親相姦|人妻)(?:[\s._-]|$)",
    r"(?:^|[\s._\[-])(Brazzers|BangBros|RealityKings|Nubiles|MetArt|Hegre|FakeTaxi|Blacked|Tushy|Vixen|Deeper|AllGirlMassage|MomsBangTeens|BadDaddyPOV|PornFidelity|SexMex|NewSensations|LegalPorno|PornWorld|WhenGirlsPlay|DigitalPlayground|NaughtyAmerica|Babes\.com|MoFos|TeamSkeet|Perv|FTVGirls|Karups|ATKGirlfriends|GirlsWay|HardX|EvilAngel|JulesJordan|Milfy|FiLF|PublicPickups|OldGoesYoung|FacialAbuse|WhiteTeensBlackCocks|MuchaSexo|PrivateSociety|ALSScan|OnlyFans|DontBreakMe|Mofos|PropertySex|FakeHub|Nubile[s]?Films|DadCrush|SisLovesMe|MyFamilyPies|PureTaboo|Vixenplus|Slayed|Twistys|PassionHD|FantasyHD|CastingCouch|ExploitedCollegeGirls|GloryholeSwallow|SpankBang|Caribbeancom|1Pondo|Heyzo|TokyoHot|Pacopacomama|10Musume|Kin8tengoku|PornPros|DaneJones|SexArt|AllFineGirls|PureMature|Lubed|Holed|Tiny4K|GirlsDoPorn|Playboy|Penthouse|DigitalDesire|Scoreland|DDFNetwork|AnalVids|GonzoXXX|ManuelFerrara|Dorcel|Private\.com|Wicked|SweetSinner|MissaX|FamilyStrokes|StepSiblings|BrattySis)[\s._\]-]",
    r"(?:^|[\s._-])FC2[-_]?PPV[-_]?\d{5,}",
    r"\[(?:FHD|HD|SD|4K|UHD)\]\s*([A-Z0-9]{2,10})-(\d{3,5})",
    r"(?:^|[\s._-])(XXX|porn|hentai|jav|erotic[ao]?|gangbang|creampie|blowjob|handjob|deepthroat|bukkake|BDSM|femdom|cuckold|futanari|ahegao|orgasm|masturbat|dildo|vibrator|anal\.?sex|oral\.?sex|squirt(?:ing)?|cumshot|threesome|foursome|double.?penetration|ass.?fuck|face.?fuck|tit.?fuck|rough.?sex|interracial|hotwife|swinger)(?:[\s._-]|$)",
    r"(?:骚|淫|肏|屄|鸡巴|阴茎|阴道|做爱|口交|肛交|中出|颜射|潮吹|痴女|素人|熟女|巨乳|爆乳|无码|有码|抽插|啪啪|约炮|嫩穴|荡妇|淫妻|绿帽|裸聊|自慰|大奶|美鲍|馒头逼|丝袜诱惑|失禁|大尺度|福利姬|操到|内射|白虎|粉穴|美臀|翘臀|骑乘|后入|口爆|吞精|足交|乳交|3P|多P|群P|调教|捆绑|露出|野战|车震|偷拍|走光|透视|鱼香肉丝|蜜桃|果冻|麻豆|探花)",
    r"(?:推特.*粉丝.*福利|门槛福利|反差婊|极品.*母狗|阿黑颜|欺负操|狠狠.*操|全网.*裸聊|最新流出.*大尺度|宿舍.*诱惑)",
    r"(?:^|[\s._\[-])(Otomedori|Koutetsu no Majo Annerose|Kuroinu|Euphoria|Starless|Bible Black|La Blue Girl|Words Worth|Discipline|Stringendo|Resort Boin|Kanojo x Kanojo|Overflow|Rance|Mokkai Shiyo|Sei Yariman|Dropout|JK to Ero Konbini|Mankitsu Happening|Baku Ane|Shikkoku no Shaga|Tsumamigui|Kansen Ball Buster|Kyonyuu|Eroge|Itadaki Seieki|Shoujo Ramune|Maki-chan to Nau)(?:[\s._\]-]|$)",
    r"(?:sex8\.cc|91porn|pornhub|xvideos|xhamster|xnxx|javbus|javlib|avgle|18p2p|hjd2048|69av|theporn|selang|suu55|色狼网|性吧|swag\.live|麻豆传媒|蜜桃传媒|果冻传媒|星空传媒|天美传媒|madoubt\.com|caribbeancom|1pondo|heyzo|tokyohot|10musume|kin8tengoku|pacopacomama|383229\.xyz|1024core|t66y|thz\.la|sehuatang|onejav|javmost|javfinder|javguru|javhdporn|javbangers|javhd\.pro|supjav|missav|jable\.tv|XiuRen|MyGirl|Ugirls|Youmi|Xiaoyu|HuaYang|MFStar|MiStar|51vv|91porn\.com|caoliu|1024cl|t66y\.com|草榴|色中色|香蕉社区|Yurievij)",
    r"(?:^|[\s._-])(Udemy|Coursera|Masterclass|Tutorial|Bootcamp|Course|Certification|Learn\s+\w+\s+in|Complete\s+Guide|from\s+Zero\s+to\s+Hero)(?:[\s._-]|$)",
]
# Fixed value.
ANIME_KEYWORDS = [
    "fansub", "anime", "hi10p", "hi10", "dual-audio", "dual audio",
]
# Fixed value.
TV_KEYWORDS = [
    "s01e", "s02e", "s03e", "s04e", "s05e", "s06e", "s07e", "s08e", "s09e", "s10e", "complete series",
    "complete season", "season 1", "season 2", "season 3", "temporada", "temp.", "cap.",
]
# Fixed value.
MOVIE_KEYWORDS = [
    "bluray", "blu-ray", "web-dl", "webdl", "remux", "imax",
]
# Fixed value.
#: Ordered quality levels by substrings of the lower-case name.
QUALITY_WORDS = [
    ("uhd", ["2160p", "4k", "uhd"]),
    ("fhd", ["1080p", "1080i", "fhd", "fullhd"]),
    ("hd", ["720p", "720i"]),
    ("sd", ["480p", "480i", "576p", "576i", "dvdrip", "dvd-rip", "sdtv", "dsr", "xvid", "divx"]),
]
# Fixed value.
QUALITY_OF_RESOLUTION = {"2160p": "uhd", "1080p": "fhd", "720p": "hd", "576p": "sd", "480p": "sd"}
# Fixed value.
CATEGORIES = ["movie", "tv", "anime", "unknown"]
# Fixed value.
QUALITIES = ["unknown", "sd", "hd", "fhd", "uhd"]
# Fixed value.
MATCH_STATES = ["unmatched", "matched", "failed"]
# Fixed value.
SOURCES = ["dht", "bitmagnet"]
# Fixed value.
EPISODE_FILE = [r"[\s._-](\d{1,3})(?:[\s._-]|$)", r"S\d{1,2}E\d{1,2}", r"Episode[\s._]?\d{1,3}"]
# Fixed value.
#: Parts of anime titles that count as white space, in this order, and ends that are dropped.
ANIME_SPACED = [r"\[[^\]]*\]", r"\([^)]*\)", r"[._-]", r"\b(?:season\s*\d+|\d+(?:st|nd|rd|th)\s*season|part\s*\d+|cour\s*\d+)\b", r"\s+"]
# Fixed value.
ANIME_TAILS = [r"\s+(?:ii|iii|iv|v|vi|vii|viii|ix|x)", r"\s+(?:batch|complete|the\s+animation)"]

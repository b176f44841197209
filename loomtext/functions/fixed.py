"""Fixed values of the chat filters and the chat cleaner: results depend on every one of them.

Patterns are those of Python's ``re``, searched in either case; ``text.java`` puts them into Java's terms.
"""

# Words in which a line is dropped before it is cleaned.
KEYWORDS = [
    "instagram", "facebook", "twitter", "tiktok", "snapchat",
    "telegram", "discord", "whatsapp", "onlyfans", "patreon",
    "ko-fi", "buff",
]

# Advertisements in a corpus line.
SPAM = ["torrent", "download", "dubbed", "bluray", "x264", "1080p", "720p"]

# Greetings and other fillers.
FILLER = [
    r"^good\s*(morning|evening|night|afternoon)",
    r"^(jay|jai|jy)\s+nepal",
    r"^me\s+(the\s+)?regular",
    r"^i\s+am\s+(watching|listening)",
    r"^(hello|hi|hey|hlo|hii)\b",
    r"^(lol|haha|hehe|wow|nice|great|cool|ok|okay)\b",
    r"^(nepal\s+)?zindabad",
    r"jay\s+nepal\s*$",
    r"^jy\s+\w",
]

# Listeners who say from where they listen, by version.
LISTENER = {
    1: [
        r"\b(sunxu|herxu|herne|sunchhu)\b.*\b(bata|jilla)\b",
        r"\bdainik\s+herne\b",
        r"\bregular\s+(listener|viewer|sunxu|herxu)\b",
        r"\bma\s+dainik\b",
        r"\bwatching\s+(from|live)\b",
        r"बाट\s*दैनिक\s*हेर्ने",
        r"नगरपालिका.*दैनिक",
        r"bata\s+dainik",
        r"\bरेगुलर\b",
        r"न\s*पा\s+बाट\s+रेगुलर",
        r"\bpa\s+bata\s+regular\b",
    ],
    2: [
        r"\b(sunxu|herxu|herne|sunchhu)\b.*\b(bata|jilla)\b",
        r"\bbata\b.*\b(herxu|sunxu)\b",
        r"\b(herxu|sunxu)\b.*\bregular\b",
        r"\bdainik\s+herne\b",
        r"\bregular\s+(listener|viewer|sunxu|herxu)\b",
        r"\bma\s+dainik\b",
        r"\bwatching\s+(from|live)\b",
        r"बाट\s*दैनिक\s*हेर्ने",
        r"नगरपालिका.*दैनिक",
        r"bata\s+dainik",
        r"\bरेगुलर\b",
        r"न\s*पा\s+बाट\s+रेगुलर",
        r"\bpa\s+bata\s+regular\b",
    ],
}

# Short reactions.
REACTION = [
    r"^(hoho|haha|lol|wow|finally)\b",
    r"\bjel\s+(kochnu|haal|halnu)\b",
    r"^sabai\s+\w+\s+(lai\s+)?jel\b",
    r"^\w+\s+le\s+thik\s+bhan",
    r"^\w{1,15}\s+sir\s+please\b",
    r"kunai\s+pani\s+parti\s+ko.*baputi",
]

# Vague English.
VAGUE = [
    r"^if\s+\w+\s+(come|win|lose|get|become)",
    r"^if\s+u\s+",
    r"^just\s+look\s+(at|in|what)",
    r"^(see|look|watch)\s+what\s+happen",
    r"baputi\s+banera\s+basdainan",
]

# Devotional phrases.
DEVOTIONAL = [
    r"\bradhe\s+radhe\b",
    r"\bom\s+shanti\b",
    r"\bjay\s+shree\s+ram\b",
    r"\bjay\s+shri\s+ram\b",
    r"\bsadh\s+guru\b",
    r"\bhari\s+om\b",
    r"\bom\s+namah\b",
    r"\bbhagwan\s+jay\b",
    r"\bjay\s+mata\b",
    r"\bjai\s+shree\b",
]

# Opinions of little content, by version.
LOW_CONTENT = {
    1: [
        r"जे मन लाग्यो",
        r"तेही भन्न लाग्यो",
        r"सुभकामना.*अनुरोध",
        r"अनैतिक काम.*अनुरोध",
        r"^kina\s+aadha\b",
        r"^kina\s+\w+\s+matra\b",
        r"charmari\s+la\s+garda",
        r"vaster\s+vaiko",
        r"^samachar\s+ko\s+kura\s+matra\s+gar",
        r"doctor\s+hoinau\s+bujheu",
    ],
    2: [
        r"जे मन लाग्यो",
        r"तेही भन्न लाग्यो",
        r"सुभकामना.*अनुरोध",
        r"अनैतिक काम.*अनुरोध",
        r"^kina\s+aadha\b",
        r"^kina\s+\w+\s+matra\b",
        r"charmari\s+la\s+garda",
        r"vaster\s+vaiko",
        r"^samachar\s+ko\s+kura\s+matra\s+gar",
        r"doctor\s+hoinau\s+bujheu",
        r"बुढो\s+मान्छेको\s+पुरानै\s+सोच",
        r"\bchintai\s+chinta\b",
        r"\bbisram\s+linu\s+hosh\b",
        r"प्वाँख\s+पलाएको",
        r"अचम्म\s+लाग्छ",
        r"बिरालोले\s+मुसा\s+मर्दैन",
        r"धेरै\s+मन्त्री\s+काम\s+छैन",
        r"बालेन\s+(लाई\s+)?नै\s+(प्राधान|प्रधान)\s+मन्त्री\s+दिनु\s+पर्छ",
        r"आधा\s+आधा\s+कार्यकाल",
        r"बालेन\s+नै\s+हुनुपर्छ",
        r"५\s*वर्षसम्म\s+बालेन",
    ],
}

# Words that keep an English line on topic.
TOPICS = [
    "nepal", "nepali", "balen", "rabi", "sarkar", "sarkaar", "congress", "kangres", "kangren", "kangresh", "amale", "uml",
    "maoist", "mawobadi", "maobadi", "communist", "government", "minister", "vote", "election", "rastriya", "sambidhan",
    "prachanda", "deuba", "oli", "koirala", "madhes", "janajati", "province", "pradesh",
    "kathmandu", "pokhara", "rsp", "ncp", "girija", "sushila", "karki", "bikalpa", "desh", "janta", "janata", "bikas",
]

# Promotional phrases, taken out in this order.
PROMOTION = [
    "video mann parey maa like", "share ra subscribe garnu hola",
    "also follow on instagram", "like.*share.*subscribe",
    "follow on instagram", "click.*subscribe", "press.*bell.*icon",
    "don't forget to subscribe", "please subscribe", "like and share",
    "subscribe to my channel", "follow me on", "check out my",
    "support my channel",
]

# Character ranges of emoji.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}"
    r"\x{1F300}-\x{1F5FF}"
    r"\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}"
    r"\x{1F900}-\x{1F9FF}"
    r"\x{1FA70}-\x{1FAFF}]+"
)

# Entities and what takes their place, in this order.
ENTITIES = [
    ("&quot;", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&#39;?", ""),
    ("&[a-zA-Z]+;", ""),
    (r"&[^;\s]+;", ""),
]

# Links, tags, ids, times and mentions, taken out in this order.
LINKS = [
    r"https?://\S+",
    r"ftp://\S+",
    r"www\.\S+",
    r"youtu\.be/\S+",
    r"youtube\.com/\S+",
    r"\S+\.(com|org|net|io|co|in|ly|be)/\S+",
    r"http\S+",
    r"<[^>]+>",
    r"</?[a-zA-Z][^>]*>?",
    r"(?i)\b(a\s+href|href\s*=)[^\s]*",
    r"""href\s*=\s*["'][^"']*["']""",
    r"\bbr\b",
    r"\b[A-Za-z0-9_-]{20,}\b",
    r"^\s*\d+\s+",
    r"\b\d+:\d+(?::\d+)?\b",
    r"@\S+",
    r"@",
]

# Laughter and noise words, taken out in this order after the promotional phrases.
NOISE = [
    r"(?i)(\b(ha|haha|lol|xD)\s*){2,}$",
    r"(?i)(\bha\s+){3,}",
    r"(?i)\balso\b",
    r"(?i)\bra\b",
    r"(?i)\bbr\b",
]

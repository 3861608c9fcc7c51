"""Values that have to be the same everywhere for results to agree: word lists, limits, formats."""

# --- Fixed values: corpus cleaning ---------------------------------------------------------------
NOISE_WHOLE_LINE = [
    r"ban c[oơ] y[eế]u ch[ií]nh ph[uủ]",
    r"h[oọ]c vi[eệ]n k[yỹ] thu[aậ]t m[aậ]t m[aã]",
    r"c[oọ]ng h[oò]a x[aã] h[oộ]i ch[uủ] ngh[iĩ]a vi[eệ]t nam",
    r"đ[oộ]c l[aâ]p\s*[-–]\s*t[uư] do\s*[-–]\s*h[aạ]nh ph[uú]c",
    r"cộng hòa xã hội chủ nghĩa việt nam",
    r"độc lập – tự do – hạnh phúc",
    r"th[oô]ng b[aá]o",
    r"trang",
    r"/tb-hvm",
    r"/qđ-hvm",
    r"\d{1,3}",
]
NOISE_LINE_START = [
    r"s[oố]\s*:",
    r"h[aà] n[oộ]i, ngày",
    r"trang\s*\d+",
    r"tm\.",
    r"kt\.",
    r"tl\.",
    r"k[ýy] tên",
]
RULER_CHARACTERS = r"\x{2500}-\x{257F}\x{2010}-\x{2015}¯_\-=–—."
ENACTMENT_NOTE = r"\(ban hành kèm theo[^)\n]*\)"
DOCUMENT_CODE = r"/(?:TB|QĐ|QD)-HVM"

# --- Fixed values: chunking ----------------------------------------------------------------------
MIN_FLOOR = 20
MIN_CHARS = 200
MAX_CHARS = 1200
BREAK_THRESHOLD = 0.5
CONTEXT_WINDOW = 1
SEMANTIC_MAX_CHARS = 3000
SEMANTIC_MAX_SENTENCES = 30
PARENT_CHARS = 600
TABLE_MAX_CHARS = 1800
TABLE_MIN_CHARS = 30
FIGURE_MAX_CHARS = 900
FIGURE_MIN_CHARS = 30
COALESCE_EXTRA = 150
OVERLAP_EXTRA = 40
MAX_UPLOAD_RECORDS = 500

# --- Fixed values: near-duplicate rule -----------------------------------------------------------
DEDUP_THRESHOLD = 0.92
DEDUP_JACCARD = 0.88
DEDUP_LENGTH_RATIO = 0.6
DEDUP_LOOK_BACK = 30
DEDUP_GATE_CHUNKS = 200
DEDUP_GATE_DOCS = 400

# --- Fixed values: retrieval ---------------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.4
VECTOR_WEIGHT = 0.4
BM25_WEIGHT = 0.6
RRF_K = 60
RETRIEVE_TOP_K = 5
RERANK_TOP_K = 4

# --- Fixed values: service limits ----------------------------------------------------------------
CATEGORY_ORDER = ["quyet_dinh", "quy_che", "quy_dinh", "tai_lieu_huong_dan", "thong_bao"]
CONVERSATION_WINDOW = 16
SUMMARY_THRESHOLD = 20
HISTORY_CHARS = 600
STORED_HISTORY = 100
SESSION_TTL_SECONDS = 24 * 3600
MAX_SESSIONS = 200
RATE_LIMIT_MAX = 30
RATE_LIMIT_WINDOW = 60
CHAT_DAILY_LIMIT = 200
CACHE_TTL_SECONDS = 600
CACHE_MAX_ITEMS = 1000
METRICS_TAIL = 5000
UPLOAD_SUFFIXES = [".pdf", ".docx", ".txt", ".md", ".csv", ".log"]
CORPUS_SUFFIXES = [".pdf", ".docx", ".txt"]
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_UPLOADS_PER_SESSION = 10
MAX_UPLOAD_MB_PER_USER = 500

# --- Fixed values: untrusted-text guard ----------------------------------------------------------
DATA_START = "<<<UNTRUSTED_DATA>>>"
DATA_END = "<<<END_UNTRUSTED_DATA>>>"
INJECTION_PATTERNS = [
    r"ignore\s+previous\s+instructions",
    r"ignore\s+all\s+instructions",
    r"system\s*:\s*",
    r"you\s+are\s+now",
    r"disregard\s+.*instructions",
    r"reveal\s+system\s+prompt",
    r"show\s+system\s+prompt",
    r"tiết\s+lộ.*prompt",
    r"quên\s+.*lời\s+dặn",
    r"bỏ\s+qua.*quy\s+tắc",
    r"hãy\s+làm\s+theo.*dưới\s+đây",
    r"```system",
    r"<\s*system\s*>",
    r"\{\{\s*system",
    r"assistant\s+to\s+system",
    r"jailbreak",
    r"DAN\s+mode",
]
FORBIDDEN_OUTPUT_PATTERNS = [
    r"system\s+prompt",
    r"lời\s+dặn\s+hệ\s+thống",
    r"instruction\s+hierarchy",
    r"<<<UNTRUSTED_DATA",
    r"SECURITY_RULES",
    r"Bạn\s+là\s+trợ\s+lý.*Học\s+viện.*Mật\s+mã.*Thứ\s+tự\s+ưu\s+tiên",
    r"THỨ\s+TỰ\s+ƯU\s+TIÊN.*Quy\s+tắc\s+hệ\s+thống",
]
MSG_NO_SOURCE = "Không đủ nguồn trong tài liệu để trả lời chắc chắn."
MSG_NO_SYSTEM = "Mình không thể chia sẻ thông tin hệ thống."
MSG_REFUSED = "Mình không thể thực hiện yêu cầu đó. Bạn cần hỗ trợ gì về quy chế, quy định?"
MSG_HIDDEN = "[đã ẩn]"
MSG_SCRIPT = "[đã loại bỏ script]"
MSG_REMOVED = "[đã loại bỏ]"
MSG_CUT_SENTENCE = "\n\n...[còn tiếp - vui lòng hỏi 'nói tiếp' để xem phần còn lại]"
MSG_CUT = "...[cắt bớt do vượt ngưỡng - vui lòng hỏi 'nói tiếp']"
MSG_TRUNCATED_DATA = "...[cắt bớt]"
MSG_EMPTY_DATA = "(không có dữ liệu)"
MSG_NO_CONTEXT = (
    "(Không có ngữ cảnh phù hợp - hãy trả lời: Không đủ nguồn trong tài liệu để trả lời chắc chắn.)"
)
MAX_ANSWER_CHARS = 12000

# --- Fixed values: routing word lists ------------------------------------------------------------
STYLES = [
    "formal", "friendly", "concise", "detailed", "simple", "academic", "casual",
    "humorous", "empathetic", "creative", "bullet", "step_by_step", "plain",
]
DEFAULT_STYLE = "formal"
STYLE_WORDS = {
    "formal": ["hành chính", "trang trọng", "formal", "nghiêm túc", "chuẩn mực"],
    "friendly": ["thân thiện", "friendly", "gần gũi", "ấm áp"],
    "concise": ["ngắn gọn", "concise", "tóm tắt", "súc tích", "ngắn thôi"],
    "detailed": [
        "chi tiết", "chi tiet", "detailed", "đầy đủ", "day du", "cặn kẽ", "can ke",
        "giải thích kỹ hơn", "giai thich ky hon", "kỹ hơn", "ky hon", "cụ thể", "cu the",
        "khoản", "khoan", "điều", "dieu", "so sánh", "so sanh", "phân biệt", "phan biet",
        "liệt kê đầy đủ", "liet ke day du",
    ],
    "simple": ["đơn giản", "dễ hiểu", "simple", "dễ đọc", "phổ thông"],
    "academic": ["học thuật", "academic", "nghiên cứu"],
    "casual": ["tự nhiên", "đời thường", "casual", "thoải mái"],
    "humorous": ["hài hước", "vui", "hài", "humorous", "vui nhộn"],
    "empathetic": ["đồng cảm", "empathetic", "chia sẻ"],
    "creative": ["sáng tạo", "creative", "mới mẻ"],
    "bullet": ["gạch đầu dòng", "bullet", "dạng liệt kê", "liệt kê"],
    "step_by_step": ["từng bước", "step by step", "theo bước", "quy trình"],
    "plain": [
        "không gọi hàm", "khong goi ham", "không dùng hàm", "khong dung ham", "không kỹ thuật",
        "khong ky thuat", "plain", "đừng dùng kiểu gọi hàm", "dung dung kieu goi ham",
        "không giải thích bằng gọi hàm", "khong giai thich bang goi ham",
        "không dùng kiểu gọi hàm", "khong dung kieu goi ham",
    ],
}
STYLE_TEMPERATURE = {
    "formal": 0.1, "friendly": 0.6, "concise": 0.2, "detailed": 0.4, "simple": 0.5, "academic": 0.1,
    "casual": 0.7, "humorous": 0.8, "empathetic": 0.6, "creative": 0.8, "bullet": 0.2,
    "step_by_step": 0.2, "plain": 0.5,
}
STYLE_CLAUSE_WORDS = ["khoản", "khoan", "điều", "dieu"]
STYLE_CLAUSE_DETAIL = [
    "giải thích", "giai thich", "kỹ hơn", "ky hon", "chi tiết", "chi tiet", "cụ thể", "cu the",
    "là gì", "la gi", "quy định", "quy dinh", "nói rõ", "noi ro", "thế nào", "the nao",
]
STYLE_INTENT = [
    "đổi", "doi", "chuyển", "chuyen", "phong cách", "phong cach", "giọng", "giong", "kiểu", "kieu",
    "giải thích", "giai thich", "trả lời", "tra loi", "dùng", "dung", "không dùng", "khong dung",
    "đừng", "hãy", "hay", "theo", "style", "kỹ hơn", "ky hon", "chi tiết", "chi tiet", "khoản",
    "khoan", "điều", "dieu", "cụ thể", "cu the", "so sánh", "so sanh", "phân biệt", "phan biet",
    "không gọi hàm", "khong goi ham", "không dùng hàm", "khong dung ham",
]
STYLE_PLAIN_ALONE = ["không gọi hàm", "không dùng hàm", "không giải thích bằng gọi hàm"]
SOCIAL_WORDS = [
    "xin chào", "chào bạn", "chào", "hello", "hi", "hey",
    "bạn khỏe không", "khỏe không", "khoe khong", "bạn khỏe", "khỏe chứ",
    "cảm ơn", "cam on", "cám ơn", "thank",
    "tạm biệt", "bye", "goodbye",
    "bạn là ai", "ban la ai", "giới thiệu", "gioi thieu",
    "hôm nay thế nào", "hom nay the nao", "thời tiết", "thoi tiet",
    "kể chuyện", "ke chuyen", "đùa", "dua", "vui", "haha", "hihi",
    "giúp tôi", "giup toi", "bạn có thể", "ban co the",
    "tên bạn", "ten ban", "bạn tên gì",
    "chúc", "chuc", "buổi sáng", "buoi sang", "buổi tối", "buoi toi",
]
PROFESSIONAL_WORDS = [
    "quy chế", "quy định", "quyết định", "thông báo", "tài liệu", "học viện", "kỹ thuật mật mã",
    "đào tạo", "khảo thí", "học bổng", "tốt nghiệp", "tín chỉ",
]
PROFESSIONAL_WORDS_WIDE = [
    "quy chế", "quy định", "quyết định", "thông báo", "tài liệu", "học viện", "kỹ thuật mật mã",
    "đào tạo", "khảo thí", "học bổng", "tín chỉ", "trang phục", "văn hóa", "kỷ luật", "tốt nghiệp",
    "môn học", "học phí", "điểm", "thi ", "lớp", "giảng viên",
]
RECALL_WORDS = [
    "vừa hỏi", "vua hoi", "câu đầu", "cau dau", "câu thứ nhất", "cau thu nhat", "câu trước",
    "cau truoc", "hỏi gì trước", "hoi gi truoc", "nhớ lại", "nho lai", "tóm tắt lại hội thoại",
    "tom tat lai hoi thoai", "lịch sử hội thoại", "lich su hoi thoai", "đã hỏi gì", "da hoi gi",
    "câu hỏi đầu tiên", "ban đầu hỏi", "ban dau hoi",
]
RECALL_TRIPLE = [
    ["tôi", "toi"],
    ["hỏi", "hoi"],
    ["gì", "gi"],
    ["vừa", "vua", "đã", "da", "trước", "truoc", "đầu", "dau"],
]
PRONOUN_WORDS = [
    "nó ", "nó?", "nó.", "nó,", "cái đó", "cái này", "ở trên", "trong đó", "trong đấy", "như trên",
    "đó là gì", "này là gì", "của nó", "cho nó", "về nó", "nói rõ hơn", "chi tiết hơn",
    "giải thích thêm", "còn ", "no ", "no?", "no.", "no,", "cai do", "cai nay", "trong do",
    "trong day", "nhu tren", "cua no", "cho no", "ve no", "noi ro hon", "chi tiet hon",
]
SHORT_FOLLOW_UPS = [
    "là gì?", "là sao?", "tại sao?", "thế nào?", "bao nhiêu?", "khi nào?", "ở đâu?", "la gi?",
    "la sao?", "the nao?", "bao nhieu?",
]
REWRITE_PRONOUNS = ["nó", "cái đó", "cái này", "trong đó", "ở trên"]
VAGUE_PHRASES = [
    "nó là gì", "cái đó là gì", "cái này là gì", "việc đó là gì", "điều đó là gì",
    "thế nào", "ra sao", "sao vậy", "là sao", "là gì vậy", "là gì thế",
    "nói rõ hơn", "giải thích thêm", "còn gì nữa", "tiếp đi", "kể thêm",
    "quy định đó", "quy chế đó", "thông báo đó", "quyết định đó",
]
VAGUE_THAT = ["quy định đó", "quy chế đó", "thông báo đó", "quyết định đó"]
VAGUE_SHORT = ["nó là gì", "cái đó là gì", "cái này là gì", "thế nào", "ra sao"]
VAGUE_BARE = ["là gì?", "là gì", "thế nào?", "thế nào", "ra sao?", "ra sao", "sao vậy?", "sao vậy"]
STANDALONE_VAGUE = ["nó", "cái đó", "cái này", "việc đó"]
IMPERATIVE_WORDS = [
    "hãy", "vui lòng", "yêu cầu", "đề bài", "bài tập", "câu hỏi", "trả lời", "giải thích", "tóm tắt",
    "phân tích", "liệt kê", "làm gì", "là gì", "tại sao", "thế nào", "bao nhiêu", "khi nào",
    "hãy cho biết", "cho biết", "nêu", "trình bày", "exercise", "question", "answer", "please",
    "summarize",
]
STRONG_IMPERATIVES = [
    "hãy", "vui lòng", "vui long", "hay tom tat", "hãy tóm tắt", "tom tat", "tóm tắt", "phan tich",
    "phân tích", "tra loi", "trả lời", "giai thich", "giải thích", "hay cho biet", "hãy cho biết",
]
REFUSAL_MARKERS = [
    "khong co thong tin", "khong tim thay", "khong de cap", "khong co trong tai lieu", "khong ro",
    "khong du thong tin", "chua co thong tin", "khong duoc de cap", "khong co du lieu",
    "khong the tra loi", "khong lien quan",
]
DANGLING_ENDINGS = [
    " và", " hoặc", " thuộc", " khối", " đảng", " chính", " đảng-chính", " thì", " là", " với",
    " của", " cho", " trong", " tại", " để", " về", " đến", " theo", " như", ",", ":", "-", "–",
    "—", "/",
]
CHART_WORDS = ["biểu đồ", "bieu do", "chart", "graph", "sơ đồ", "so do"]
ILLUSTRATION_WORDS = ["hình", "ảnh", "figure", "minh họa", "minh hoa"]
CLARIFY_BASE = (
    "Câu hỏi của bạn hơi chung chung nên mình chưa chắc bạn đang muốn hỏi về phần nào. "
    "Bạn có thể nói rõ hơn một chút được không? "
)
CLARIFY_HINTS = (
    "Ví dụ: quy chế đào tạo, quy định văn hóa học đường (trang phục, giao tiếp), quy định khảo thí, "
    "học bổng/học phí, hay thông báo cụ thể nào?"
)
CLARIFY_RULE = (
    "Bạn đang muốn hỏi về quy định nào trong số trên? Cho mình xin tên quy định hoặc nội dung cụ thể "
    "hơn nhé."
)
CLARIFY_STATUTE = (
    "Bạn muốn hỏi về quy chế nào? Ví dụ quy chế đào tạo hay quy chế công tác học viên?"
)

# --- Fixed values: replies without a model ---------------------------------------------------------
SOCIAL_REPLIES = [
    (
        ["xin chào", "chào bạn", "chào", "hello", "hi", "hey"],
        "Xin chào! Mình khỏe, cảm ơn bạn đã hỏi thăm. Bạn cần mình hỗ trợ gì về quy chế, quy định hay thông tin nào khác không?",
    ),
    (["khỏe"], "Mình khỏe, cảm ơn bạn! Bạn đang cần tìm hiểu thêm về vấn đề gì?"),
    (["cảm ơn", "cam on"], "Không có gì, rất vui được giúp bạn! Bạn cần hỏi thêm gì nữa không?"),
    (["tạm biệt", "bye"], "Tạm biệt bạn nhé! Hẹn gặp lại khi bạn cần hỗ trợ thêm."),
]
SOCIAL_WHO_WORDS = ["bạn là ai", "gioi thieu"]
SOCIAL_OTHER = "Chào bạn! Mình ở đây để trò chuyện và hỗ trợ bạn. Bạn muốn hỏi về vấn đề gì?"

# --- Replies to a change of style and to questions about the conversation (fixed texts) ---------------
STYLE_CONFIRM_REQUEST = "Xác nhận đã đổi sang phong cách "
STYLE_CONFIRM_WORD = "phong cách"
STYLE_CONFIRMED = "Đã đổi sang phong cách "
STYLE_CONFIRMED_END = ". Từ giờ mình sẽ trả lời theo phong cách này nhé. Bạn cần hỏi gì tiếp?"
RECALL_REQUEST = " (Hãy trả lời dựa trên lịch sử hội thoại đã cung cấp, liệt kê chính xác các câu hỏi trước, đặc biệt là câu đầu tiên.)"
RECALL_LACK = "không đủ nguồn"
RECALL_LISTING = "Các câu hỏi bạn đã hỏi trong phiên này:\n"
RECALL_FIRST = "\n\nCâu đầu tiên là: \""
RECALL_NO_QUESTION = "Lịch sử hội thoại hiện tại trống, chưa có câu hỏi nào trước đó."
RECALL_NO_HISTORY = "Chưa có lịch sử hội thoại để nhớ lại."

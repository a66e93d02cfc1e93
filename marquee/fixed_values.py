"""Values that results must agree on, stated as they are."""

# Statuses and types.
BOOKING_STATUSES = ["PENDING", "BOOKED", "CANCLED"]
PAYMENT_STATUSES = ["PENDING", "PAID", "RETURNED", "CANCLED"]
SEAT_STATUSES = ["UNAVAILABLE", "AVAILABLE", "PENDING", "BOOKED", "CANCLED"]
SEAT_TYPES = ["REGULAR", "PREMIUM"]
USER_STATUSES = ["ACTIVE", "CLOSED", "CANCELED", "BLACKLISTED", "BLOCKED"]

# Prices, sizes, limits and durations.
REGULAR_PRICE = 10000.0
OTHER_PRICE = 20000.0
CLEANING_MINUTES = 10
MAX_SEATS_PER_REQUEST = 4
MIN_HALL_SIDE = 5
MIN_RATING = 0
MAX_RATING = 5
PENDING_TIMEOUT_MINUTES = 15
RETRY_ATTEMPTS = 3
RETRY_PAUSE_SECONDS = 2.0
SPAM_LIMIT = 3
NEWEST_MOVIES = 10
TOP_MOVIES_PER_DAY = 5
RECOMMENDATIONS = 8
PAGE_SIZE_CAP = 50
DEDUP_SECONDS = 3600
FAST_SECONDS = 30
FAST_COUNT = 3
HISTORY_LENGTH = 20
HISTORY_MINIMUM = 5
HISTORY_DAYS = 30
Z_LIMIT = 3.0
HIGH_AMOUNT = 1000000.0
LOGIN_LIMIT = 5
LOGIN_SECONDS = 60

# Anomaly type, risk score, description.
ANOMALY_FAST = ("MULTIPLE_FAST_TRANSACTION", 0.8, "Multiple fast transactions")
ANOMALY_FAILED_CHARGED = ("FAILED_BUT_CHARGED", 0.95, "Failed but gateway return_code == 0")
ANOMALY_DEVICE = ("DEVICE_CHANGE", 0.6, "Device/IP changed")
ANOMALY_HIGH_AMOUNT = ("HIGH_AMOUNT", 0.9, "High fixed threshold")
ANOMALY_ZSCORE = ("AMOUNT_ZSCORE", 0.92, "Z-score outlier")

# Reasons given for a rejected request.
TOO_MANY_SEATS = "You can not reverse more than 4 seats at the time."
USER_NOT_FOUND = "User is not found"
NOT_ALLOWED = "You are not allowed to book ticket"
SHOW_NOT_FOUND = "Show is not found"
SHOW_FULL = "Sorry, seats of this show are full. Please choose another show"
SEAT_NOT_FOUND = "Not found seat id: "
SEAT_RESERVED = "Seat ID %s is reserved"
TICKET_NOT_FOUND = "Ticket is not found"
TICKET_ID_NOT_FOUND = "Ticket ID %s is not found"
SAME_STATUS = "This ticket already have this status"
NOT_CANCELLABLE = "This ticket can not be cancled"
ALREADY_SETTLED = "This ticket have been already paid or canceled before."
ALREADY_PENDING = "This ticket have been already pending for payment."
UNKNOWN_STATUS = "Not found status "
BAD_DATE = "Invaild date format, it must be dd/MM/yyyy HH:mm"
HALL_NOT_FOUND = "Hall is not found"
MOVIE_NOT_FOUND = "Movie is not found"
SHOW_MISSING = "Show not found"
SHOW_CONFLICT = "Conflict start/end time with show ID: "
SEAT_MISSING = "Seat not found"
BAD_SEAT_TYPE = "Invalid seat type. It must be REGULAR or PREMIUM"
BAD_SEAT_STATUS = "Status is not found. It must be AVAILABLE or UNAVAILABLE"
NOT_OWNER = "This comment is not belonged to you"
BAD_RATING = "Rating number must be in range 0 and 5"
HALL_BAD_NAME = "Illeagal charaters in name"
HALL_EXISTS = "This hall is existed"
HALL_TOO_SMALL = "Row/Column number must be greater than 5"

# What a payment event says where it was published after the gateway's answer.
EVENT_ADDRESS = "VNPay-Callback"
EVENT_LOCATION = "VN"

# Notification wording.
MAIL_SUBJECT = "Ticket: Payment Information"
MAIL_BODY = (
    "Payment ID: %s\nTotal amount: %s\nCreate at: %s\nMovie name: %s\nHall name: %s\nStart time: %s\nSeats: %s"
)

# Letters folded in accent-insensitive search.
FOLDED_LETTERS = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ",
    "e": "èéẹẻẽêềếệểễ",
    "i": "ìíịỉĩ",
    "o": "òóọỏõôồốộổỗơờớợởỡ",
    "u": "ùúụủũưừứựửữ",
    "y": "ỳýỵỷỹ",
    "d": "đ",
}

# Characters escaped in HTML text, in the order they are replaced.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")]

# Text patterns, found anywhere unless anchored; whole texts, line breaks included.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
SQL_PATTERN = (
    r"(?i)(^|\W)(select|drop|alter|insert|update|delete)(\W|\z)"
    r"|(^|\W)\d+\W+(union|select|table|information_schema)(\W|\z)"
)
XSS_PATTERN = r"(?s)[<>\"']."
NORMAL_TEXT_PATTERN = r"^[a-zA-Z0-9\-_.!~*'()]*\z"
GOOD_PASSWORD_PATTERN = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?=.*[@#$%^&+=!])(?=\S+\z).{8,}\z"
USERNAME_PATTERN = r"^[a-zA-Z0-9._]{5,}\z"

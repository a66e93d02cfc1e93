"""Declared schemas, as DDL, of the tables and of the payment-event stream."""

from __future__ import annotations

_AUDIT = "created_at timestamp_ntz, updated_at timestamp_ntz"

SCHEMAS: dict[str, str] = {
    "movies": f"movie_id long, title string, description string, duration_mins int, language string, "
    f"release_date string, country string, image string, large_image string, trailer string, "
    f"actors string, {_AUDIT}",
    "genres": f"genre_id long, genre string, {_AUDIT}",
    "movie_genre": "movie_id long, genre string",
    "halls": f"hall_id string, name string, total_row int, total_col int, {_AUDIT}",
    "hall_seats": f"hall_id string, row_index int, col_index int, seat_type string, status string, "
    f"price double, name string, {_AUDIT}",
    "shows": f"show_id string, hall_id string, movie_id long, start_time timestamp_ntz, "
    f"end_time timestamp_ntz, {_AUDIT}",
    "show_seats": f"seat_id string, show_id string, row_index int, col_index int, status string, {_AUDIT}",
    "bookings": "booking_id string, user_id string, show_id string, status string, "
    "create_at timestamp_ntz, update_at timestamp_ntz",
    "booking_seats": "booking_id string, seat_id string, seat_type string, price double",
    "payments": "payment_id string, booking_id string, amount double, status string, txn_ref string, "
    "create_at timestamp_ntz, update_at timestamp_ntz",
    "users": "user_id string, username string, full_name string, address string, email string, "
    "phone string, created_at timestamp_ntz, status string",
    "user_roles": "user_id string, role string",
    "spam_users": "user_id string, spam_times int, update_at timestamp_ntz",
    "comments": "comment_id string, movie_id long, user_id string, comment string, rated int, "
    "liked int, disliked int, create_at timestamp_ntz, update_at timestamp_ntz",
    "anomaly_logs": "log_id string, payment_id string, user_id string, type string, risk_score double, "
    "amount double, description string, created_at timestamp_ntz",
}

# Field names as they travel on the topic.
PAYMENT_EVENT_JSON = (
    "paymentId string, userId string, movieId string, amount double, deviceIp string, time timestamp, "
    "status string, location string, returnCode string"
)

PAYMENT_EVENT = (
    "event_id string, payment_id string, user_id string, movie_id string, amount double, device_ip string, "
    "event_time timestamp, status string, location string, return_code string"
)

LOGIN_ATTEMPT = "attempt_id string, login_key string, ts timestamp"

SCHEMAS["payment_events"] = PAYMENT_EVENT
SCHEMAS["login_attempts"] = LOGIN_ATTEMPT
SCHEMAS["gateway_responses"] = (
    "txn_ref string, response_code string, amount_minor long, txn_type string, txn_status string"
)

"""The domain views in SQL, for the oracle queries."""

from __future__ import annotations

# name -> (definition, views it reads)
_VIEWS: dict[str, tuple[str, list[str]]] = {
    "payment_events": (
        """SELECT CAST(event_id AS VARCHAR) AS event_id,
                  CAST(user_id AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR) AS payment_id,
                  CAST(user_id AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS movie_id,
                  value * 10000 AS amount, '10.0.0.' || CAST(k % 4 AS VARCHAR) AS device_ip,
                  ts AS event_time,
                  CASE event_type WHEN 'purchase' THEN 'PAID' WHEN 'error' THEN 'FAILED'
                       WHEN 'signup' THEN 'CANCLED' ELSE 'PENDING' END AS status,
                  'VN' AS location, CASE WHEN k % 10 = 0 THEN '0' ELSE '24' END AS return_code
           FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
        [],
    ),
    # The first event of an id opens a day; the first at least a day later opens the next.
    "openers": (
        """SELECT payment_id, min(event_time) AS t FROM payment_events GROUP BY payment_id
           UNION ALL
           SELECT o.payment_id, min(e.event_time) FROM openers o
           JOIN payment_events e ON e.payment_id = o.payment_id AND e.event_time >= o.t + INTERVAL 1 DAY
           GROUP BY o.payment_id, o.t""",
        ["payment_events"],
    ),
    "accepted": (
        """SELECT e.* FROM payment_events e JOIN (
             SELECT min(CAST(e.event_id AS BIGINT)) AS event_no FROM openers o
             JOIN payment_events e ON e.payment_id = o.payment_id AND e.event_time = o.t
             GROUP BY o.payment_id, o.t) f ON CAST(e.event_id AS BIGINT) = f.event_no""",
        ["payment_events", "openers"],
    ),
    "arrivals": (
        """SELECT * REPLACE (CASE WHEN n % 101 <> 0 THEN payment_id END AS payment_id),
                  event_time + to_milliseconds(n * 7919 % 90000) + to_days(CASE WHEN n % 97 = 0 THEN 2 ELSE 0 END)
                    AS arrived_at FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM payment_events)""",
        ["payment_events"],
    ),
    "keyed_openers": (
        """SELECT payment_id, min(event_time) AS t FROM arrivals WHERE payment_id IS NOT NULL GROUP BY payment_id
           UNION ALL
           SELECT o.payment_id, min(e.event_time) FROM keyed_openers o
           JOIN arrivals e ON e.payment_id = o.payment_id AND e.event_time >= o.t + INTERVAL 1 DAY
           GROUP BY o.payment_id, o.t""",
        ["arrivals"],
    ),
    "keyed_accepted": (
        """SELECT e.* FROM arrivals e JOIN (
             SELECT min(e.n) AS event_no FROM keyed_openers o
             JOIN arrivals e ON e.payment_id = o.payment_id AND e.event_time = o.t
             GROUP BY o.payment_id, o.t) f ON e.n = f.event_no""",
        ["arrivals", "keyed_openers"],
    ),
    "on_time_openers": (
        """SELECT payment_id, min(event_time) AS t FROM arrivals
           WHERE payment_id IS NOT NULL AND n % 97 <> 0 GROUP BY payment_id
           UNION ALL
           SELECT o.payment_id, min(e.event_time) FROM on_time_openers o
           JOIN arrivals e ON e.payment_id = o.payment_id AND e.event_time >= o.t + INTERVAL 1 DAY AND n % 97 <> 0
           GROUP BY o.payment_id, o.t""",
        ["arrivals"],
    ),
    "on_time_accepted": (
        """SELECT e.* FROM arrivals e JOIN (
             SELECT min(e.n) AS event_no FROM on_time_openers o
             JOIN arrivals e ON e.payment_id = o.payment_id AND e.event_time = o.t AND n % 97 <> 0
             GROUP BY o.payment_id, o.t) f ON e.n = f.event_no""",
        ["arrivals", "on_time_openers"],
    ),
    "login_attempts": (
        """SELECT CAST(event_id AS VARCHAR) AS attempt_id, CAST(user_id AS VARCHAR) AS login_key, ts
           FROM events WHERE event_type IN ('signup', 'error')""",
        [],
    ),
    "movies": (
        """SELECT p_partkey AS movie_id, p_name AS title, 60 + p_size AS duration_mins,
                  TIMESTAMP '2023-01-01 00:00:00' + to_minutes(p_partkey) AS created_at, p_brand AS country
           FROM part""",
        [],
    ),
    "movie_genre": (
        """SELECT DISTINCT movie_id, genre FROM (
             SELECT p_partkey AS movie_id, unnest(string_split(p_name, ' ')) AS genre FROM part
             UNION ALL SELECT p_partkey, lower(p_type) FROM part)""",
        [],
    ),
    "incoming_movies": (
        """SELECT p_partkey AS incoming_id,
                  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) END
                    AS title, p_name, p_brand FROM part""",
        [],
    ),
    "comments": (
        """SELECT CAST(doc_id AS VARCHAR) AS comment_id, doc_id % 200 AS movie_id,
                  CAST(doc_id % 100 AS VARCHAR) AS user_id, text AS comment,
                  CAST(n_chars % 7 AS INTEGER) AS rated, CAST(n_chars % 10 AS INTEGER) AS liked,
                  CAST(n_chars % 3 AS INTEGER) AS disliked,
                  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_chars) AS update_at FROM documents""",
        [],
    ),
    "comment_edit_requests": (
        """SELECT CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE '' END || CAST(doc_id AS VARCHAR) AS comment_id,
                  CAST(CASE WHEN doc_id % 6 = 0 THEN doc_id % 100 + 1 ELSE doc_id % 100 END AS VARCHAR) AS user_id,
                  CAST(n_chars % 8 AS INTEGER) AS new_rated FROM documents""",
        [],
    ),
    "comment_requests": (
        """SELECT CAST(doc_id AS VARCHAR) AS request_id,
                  CASE WHEN doc_id % 14 <> 0 THEN doc_id % 200 END AS movie_id,
                  CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS comment FROM documents""",
        [],
    ),
    "halls": (
        """SELECT s_suppkey AS hall_id, s_name AS name, CAST(3 + s_suppkey % 5 AS INTEGER) AS total_row,
                  CAST(4 + s_suppkey % 6 AS INTEGER) AS total_col FROM supplier""",
        [],
    ),
    "hall_names_asked": (
        """SELECT 'ask-' || CAST(hall_id AS VARCHAR) AS request_id,
                  CASE WHEN hall_id % 7 = 0 THEN upper(name) ELSE name END AS name FROM halls""",
        ["halls"],
    ),
    "hall_changes": (
        """SELECT hall_id, name || '+' AS new_name, CAST(total_row + hall_id % 2 AS INTEGER) AS new_row,
                  CAST(total_col + hall_id % 3 AS INTEGER) AS new_col FROM halls""",
        ["halls"],
    ),
    "hall_seats": (
        """SELECT hall_id, row_index, col_index, 'REGULAR' AS seat_type, 'AVAILABLE' AS status, 10000.0::DOUBLE AS price,
                  name || CAST(row_index AS VARCHAR) || '.' || CAST(col_index AS VARCHAR) AS seat_name
           FROM (SELECT *, unnest(range(total_col)) AS col_index
                 FROM (SELECT *, unnest(range(total_row)) AS row_index FROM halls))""",
        ["halls"],
    ),
    "shows": (
        """SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(day AS VARCHAR)
                    AS show_id, l_suppkey AS hall_id, l_partkey AS movie_id,
                  CAST(day AS TIMESTAMP) + to_hours(l_partkey % 24) AS start_time,
                  CAST(day AS TIMESTAMP) + to_hours(l_partkey % 24) + to_minutes(p_size + 70) AS end_time
           FROM (SELECT DISTINCT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem)
           JOIN part ON p_partkey = l_partkey""",
        [],
    ),
    "show_requests": (
        """SELECT show_id AS request_id, CASE WHEN movie_id % 23 = 0 THEN -1 ELSE hall_id END AS hall_id, movie_id,
                  CASE WHEN movie_id % 17 = 0 THEN 'x' WHEN movie_id % 19 = 0 THEN '31/02/2023 14:00'
                       ELSE strftime(moved, '%d/%m/%Y %H:%M') END AS start_text,
                  CASE WHEN movie_id % 17 <> 0 AND movie_id % 19 <> 0 THEN moved END AS start_time
           FROM (SELECT *, start_time + to_minutes(CASE WHEN movie_id % 2 = 0 THEN 57600 ELSE 30 END) AS moved
                 FROM shows)""",
        ["shows"],
    ),
    "show_updates": (
        """SELECT CASE WHEN movie_id % 29 = 0 THEN 'no-' ELSE '' END || show_id AS show_id,
                  CASE WHEN movie_id % 23 = 0 THEN -1 WHEN movie_id % 5 <> 0 THEN hall_id
                       WHEN hall_id = 0 THEN 1 ELSE hall_id - 1 END AS hall_id,
                  CASE WHEN movie_id % 31 = 0 THEN -1 ELSE movie_id END AS movie_id,
                  CASE WHEN movie_id % 17 <> 0 THEN start_time + to_minutes(
                    CASE movie_id % 3 WHEN 0 THEN 45 WHEN 1 THEN 1440 ELSE 0 END) END AS asked_start FROM shows""",
        ["shows"],
    ),
    "show_seats": (
        """SELECT show_id || '#' || CAST(row_index AS VARCHAR) || '.' || CAST(col_index AS VARCHAR) AS seat_id,
                  show_id, hall_id, row_index, col_index, seat_type, price, seat_name,
                  CASE WHEN (hall_id % 7 = 0 AND movie_id % 20 = 0) OR (movie_id + 7 * row_index + col_index) % 5 = 0
                         THEN 'BOOKED'
                       WHEN (movie_id + row_index + col_index) % 7 = 0 THEN 'PENDING'
                       ELSE 'AVAILABLE' END AS status
           FROM shows JOIN hall_seats USING (hall_id)""",
        ["shows", "hall_seats"],
    ),
    "users": (
        """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username, c_name || ' of ' || c_mktsegment
                    AS full_name, 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
                  CASE WHEN c_acctbal < 0 THEN 'BLACKLISTED' ELSE 'ACTIVE' END AS status FROM customer""",
        [],
    ),
    "user_roles": (
        """SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'ROLE_USER' AS role FROM customer
           UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ROLE_ADMIN' FROM customer WHERE c_nationkey % 5 = 0
           UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ROLE_SUPER_ADMIN' FROM customer
                     WHERE c_mktsegment = 'MACHINERY'""",
        [],
    ),
    "spam_users": ("SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey % 3 AS spam_times FROM customer", []),
    "lines": (
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (
             SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                          ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem)
           WHERE rn = 1""",
        [],
    ),
    "bookings": (
        """SELECT CAST(o_orderkey AS VARCHAR) AS booking_id, CAST(o_custkey AS VARCHAR) AS user_id,
                  CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
                    || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS show_id,
                  CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'BOOKED' ELSE 'CANCLED' END AS status,
                  o_orderdate + to_minutes(o_orderkey % 1440) AS create_at
           FROM orders JOIN (
             SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn
             FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1""",
        [],
    ),
    "booking_seats": (
        """SELECT CAST(l_orderkey AS VARCHAR) AS booking_id, l_linenumber AS seat_no, l_linenumber - 1 AS row_index,
                  CAST(l_partkey % 4 AS INTEGER) AS col_index,
                  CASE WHEN l_partkey % 3 = 0 THEN 'PREMIUM' ELSE 'REGULAR' END AS seat_type,
                  CASE WHEN l_partkey % 3 = 0 THEN 20000.0::DOUBLE ELSE 10000.0::DOUBLE END AS price FROM lines""",
        ["lines"],
    ),
    "payments": (
        """SELECT 'pay-' || CAST(o_orderkey AS VARCHAR) AS payment_id, CAST(o_orderkey AS VARCHAR) AS booking_id,
                  o_totalprice AS amount, 'T' || CAST(o_orderkey AS VARCHAR) AS txn_ref,
                  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PAID'
                       WHEN o_orderpriority = '3-MEDIUM' THEN 'CANCLED' ELSE 'PENDING' END AS status,
                  o_orderdate + to_minutes(o_orderkey % 1440 + 5) AS create_at
           FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
        [],
    ),
    "gateway_responses": (
        """SELECT 'T' || CAST(o_orderkey AS VARCHAR) AS txn_ref,
                  CASE WHEN o_orderkey % 7 = 0 THEN '24' ELSE '00' END AS response_code,
                  CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END
                    AS amount_minor, '01' AS txn_type,
                  CASE WHEN o_orderkey % 13 = 0 THEN '02' ELSE '00' END AS txn_status FROM orders""",
        [],
    ),
    "booking_lookups": (
        """SELECT booking_id, CASE WHEN CAST(booking_id AS BIGINT) % 4 = 0 THEN 'not-' ELSE '' END || user_id
                    AS user_id FROM bookings""",
        ["bookings"],
    ),
    "busy_shows": ("SELECT hall_id, min(show_id) AS show_id FROM shows GROUP BY hall_id", ["shows"]),
    "request_seats": (
        """SELECT s.* REPLACE (CASE WHEN s.show_id IN (SELECT show_id FROM busy_shows) AND (row_index > 2 OR col_index > 1)
                  THEN 'UNAVAILABLE' ELSE status END AS status) FROM show_seats s""",
        ["show_seats", "busy_shows"],
    ),
    "booking_requests": (
        """SELECT request_id, CASE WHEN o % 23 = 0 THEN 'nobody' ELSE user_id END AS user_id, show_id, requested_at,
                  show_id || '#' || CAST(CASE WHEN l_linenumber = 7 THEN 9 ELSE (l_linenumber - 1) % 3 END AS VARCHAR)
                    || '.' || CAST(l_partkey % CASE WHEN o % 4 = 0 THEN 2 ELSE 4 END AS VARCHAR) AS seat_id
           FROM (SELECT b.booking_id AS request_id, CAST(b.booking_id AS BIGINT) AS o, b.user_id, b.create_at AS requested_at,
                        l_linenumber, l_partkey, CASE WHEN CAST(b.booking_id AS BIGINT) % 29 = 0 THEN 'no-show'
                          WHEN CAST(b.booking_id AS BIGINT) % 4 = 0 THEN y.show_id ELSE b.show_id END AS show_id
                 FROM bookings b JOIN lines ON CAST(l_orderkey AS VARCHAR) = b.booking_id
                 JOIN shows s ON s.show_id = b.show_id JOIN busy_shows y ON y.hall_id = s.hall_id)""",
        ["bookings", "lines", "shows", "busy_shows"],
    ),
    "payment_requests": (
        """SELECT booking_id AS request_id, CASE WHEN CAST(booking_id AS BIGINT) % 31 = 0 THEN 'no-' || booking_id
                    ELSE booking_id END AS booking_id,
                  CASE WHEN CAST(booking_id AS BIGINT) % 5 = 0 THEN 'somebody' ELSE username END AS username
           FROM bookings JOIN users USING (user_id)""",
        ["bookings", "users"],
    ),
    "status_requests": (
        """SELECT booking_id, CASE WHEN CAST(booking_id AS BIGINT) % 10 = 0 THEN 'nobody' ELSE user_id END AS user_id,
                  CASE WHEN CAST(booking_id AS BIGINT) % 7 < 2 THEN 'pending'
                       WHEN CAST(booking_id AS BIGINT) % 7 < 4 THEN 'cancled'
                       WHEN CAST(booking_id AS BIGINT) % 7 < 6 THEN 'BOOKED' ELSE 'lost' END AS to_status
           FROM bookings""",
        ["bookings"],
    ),
    "prices": (
        """SELECT booking_id, sum(price) AS price FROM booking_seats GROUP BY booking_id""",
        ["booking_seats"],
    ),
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """`body` behind WITH clauses for the named views, those they read, and `extra` ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _VIEWS[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = [f"{n} AS ({_VIEWS[n][0]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH RECURSIVE {', '.join(clauses)} {body}" if clauses else body

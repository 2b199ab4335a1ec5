"""Table schemas. Every read names one of these; nothing is inferred."""

# A submission as landed: texts as the service gives them, plus the user and the list position.
SUBMISSIONS = (
    "user_id bigint, seq bigint, title string, title_slug string, timestamp string, "
    "status string, language string, runtime string, memory string"
)

# Item metadata as landed: three cells are JSON text.
ITEMS = (
    "problem_id string, title string, title_slug string, difficulty string, topic_tags string, "
    "company_tags string, stats string, is_paid_only boolean, category string"
)

# Result tables.
PROBLEMS = (
    "user_id bigint, name string, difficulty string, topics_text string, date_solved date, "
    "attempts bigint, status string, problem_id string, last_updated timestamp"
)
ANALYTICS = (
    "user_id bigint, topic string, total bigint, solved bigint, percentage double, "
    "last_solved date, easy bigint, medium bigint, hard bigint"
)
PROGRESS = (
    "user_id bigint, date date, daily_count bigint, weekly_count bigint, monthly_count bigint, "
    "streak bigint, total_solved bigint, last_updated timestamp"
)
RESULTS = {"problems": PROBLEMS, "analytics": ANALYTICS, "progress": PROGRESS}

# A problem record after reading the Problems table back; also the rows of a backup.
RECORDS = (
    "user_id bigint, title string, difficulty string, topics array<string>, date_solved date, "
    "attempts bigint, status string, problem_id string, last_updated timestamp"
)

# Headings for people who look at the tables, in column order.
HEADINGS = {
    "problems": (
        "Problem Name", "Difficulty", "Topics", "Date Solved",
        "Attempts", "Status", "Problem ID", "Last Updated",
    ),
    "analytics": (
        "Topic", "Total Problems", "Solved", "Percentage",
        "Last Solved", "Easy", "Medium", "Hard",
    ),
    "progress": (
        "Date", "Daily Count", "Weekly Count", "Monthly Count",
        "Streak", "Total Solved", "Last Updated",
    ),
}

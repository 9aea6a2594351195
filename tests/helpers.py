"""Small helpers that test modules import by name."""
import datetime


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)

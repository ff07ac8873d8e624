"""Users, sessions and the audit log, as rows of the store."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import Store, delete_matching, insert_missing, replace_set, upsert

ROUNDS = 200_000
USERS = "user_id long, username string, salt string, password_hash string, role string"
GRANTS = "user_id long, client string"
SESSIONS = "token string, user_id long, created_at timestamp, expires_at timestamp"
AUDIT = "username string, action string, detail string, ts timestamp"


def hash_password(password: str, salt: str | None = None) -> tuple[str, str]:
    salt = salt or secrets.token_hex(16)
    return salt, hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), ROUNDS).hex()


def verify_password(password: str, salt: str, expected: str) -> bool:
    return hmac.compare_digest(hash_password(password, salt)[1], expected)


class Accounts:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def users(self) -> DataFrame:
        return self.store.read("users", USERS)

    def find(self, username: str):
        return self.users().filter(F.col("username") == username).first()

    def create(self, username: str, password: str, role: str = "lawyer", clients: list[str] | None = None) -> int:
        """A new user, or a new password and role for one there is; their grants are added."""
        have = self.find(username)
        number = have["user_id"] if have else (self.users().agg(F.max("user_id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(number, username, *hash_password(password), role)], USERS)
        self.store.change("users", USERS, lambda t: upsert(t, row, ["user_id"]))
        for client in clients or []:
            self.grant(number, client)
        return number

    def grant(self, user_id: int, client: str) -> None:
        row = self.spark.createDataFrame([(user_id, client)], GRANTS)
        self.store.change("grants", GRANTS, lambda t: insert_missing(t, row, ["user_id", "client"]))

    def revoke(self, user_id: int, client: str) -> None:
        row = self.spark.createDataFrame([(user_id, client)], GRANTS)
        self.store.change("grants", GRANTS, lambda t: delete_matching(t, row, ["user_id", "client"]))

    def set_clients(self, user_id: int, clients: list[str]) -> None:
        rows = self.spark.createDataFrame([(user_id, c) for c in clients], GRANTS)
        self.store.change("grants", GRANTS, lambda t: replace_set(t, "user_id", rows) if clients else t.filter(F.col("user_id") != user_id))

    def delete(self, username: str) -> None:
        """The user, with grants and sessions."""
        have = self.find(username)
        if have:
            for name, schema in (("users", USERS), ("grants", GRANTS), ("sessions", SESSIONS)):
                self.store.change(name, schema, lambda t: t.filter(F.col("user_id") != have["user_id"]))

    def allowed(self, user_id: int, role: str) -> list[str] | None:
        """None for an admin, else the sorted clients."""
        if role == "admin":
            return None
        return [r["client"] for r in self.store.read("grants", GRANTS).filter(F.col("user_id") == user_id).orderBy("client").collect()]

    def login(self, username: str, password: str, hours: int = 12) -> str | None:
        """A session's token, or None."""
        have = self.find(username)
        if not have or not verify_password(password, have["salt"], have["password_hash"]):
            return None
        now, token = dt.datetime.now(), secrets.token_urlsafe(32)
        row = self.spark.createDataFrame([(token, have["user_id"], now, now + dt.timedelta(hours=hours))], SESSIONS)
        self.store.change("sessions", SESSIONS, lambda t: t.unionByName(row))
        return token

    def resolve(self, token: str | None) -> dict | None:
        """The user of a session that is still valid, with what they may see."""
        found = self.store.read("sessions", SESSIONS).filter((F.col("token") == (token or "")) & (F.col("expires_at") > F.current_timestamp())).join(self.users(), "user_id").first()
        return found and {"username": found["username"], "role": found["role"], "allowed_clients": self.allowed(found["user_id"], found["role"])}

    def logout(self, token: str) -> None:
        self.store.change("sessions", SESSIONS, lambda t: t.filter(F.col("token") != token))

    def log(self, username: str | None, action: str, detail: str = "") -> None:
        """Best effort: a log that can't be written stops nobody."""
        row = self.spark.createDataFrame([(username, action, detail[:2000], dt.datetime.now())], AUDIT)
        try:
            row.write.mode("append").parquet(f"{self.store.root}/audit_log")
        except Exception:  # noqa: S110
            pass

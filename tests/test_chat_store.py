"""Chats written, changed, deleted and copied."""

import pytest

from tracegrove.sources.chat_store import ChatStore


def test_threads(spark, tmp_path):
    store = ChatStore(spark, str(tmp_path))
    assert store.list_threads().count() == 0 and store.count_threads() == 0
    a, b = store.create_thread("one", "/p"), store.create_thread("two")
    assert store.get_thread(a).first()["title"] == "one"
    assert {r.id for r in store.list_threads("/p").collect()} == {a, b} and store.count_threads("/p") == 1
    assert [r.id for r in store.list_threads(limit=1, offset=1).collect()] == [a]
    assert store.update_thread(a, summary="s", title="uno") and not store.update_thread("none", title="x") and not store.update_thread(a)
    row = store.get_thread(a).first()
    assert (row.title, row.summary, row.project_path) == ("uno", "s", "/p") and row.updated_at > row.created_at
    assert [r.id for r in store.list_threads(limit=1).collect()] == [a]
    with pytest.raises(ValueError):
        store.update_thread(a, id="x")
    assert store.delete_thread(a) and store.get_thread(a).count() == 0 and store.count_threads() == 1
    assert store.delete_thread(b, hard=True) and not store.delete_thread(b, hard=True)
    assert store._table("threads", "id string").where(f"id = '{b}'").count() == 0


def test_messages(spark, tmp_path):
    store = ChatStore(spark, str(tmp_path))
    t = store.create_thread("t")
    store.append_messages(t, [{"role": "user", "content": "q", "ts": 5}, {"role": "agent", "content": "r", "ts": 9_999_999_999_999, "evidence": [{"id": "x", "line": 3}]}])
    assert store.get_thread(t).first()["updated_at"] == 9_999_999_999_999
    store.append_message(t, "system", "s")
    rows = store.list_messages(t).collect()
    assert [r.content for r in rows] == ["q", "s", "r"] and rows[2].evidence == [{"id": "x", "line": "3"}]
    assert [r.content for r in store.list_messages(t, 1, 1).collect()] == ["s"] and store.count_messages(t) == 3
    with pytest.raises(ValueError):
        store.append_message(t, "other", "x")
    copy = store.clone_thread(t)
    assert store.get_thread(copy).first()["title"] == "t (copy)" and [r.content for r in store.list_messages(copy).collect()] == ["q", "s", "r"]
    assert store.clone_thread("none") is None
    store.append_frame(store.messages().where(f"thread_id = '{t}'").selectExpr("concat('n', id) as id", "thread_id", "role", "content", "ts + 9999999999999 as ts", "evidence_json", "1 as deleted_at"))
    assert store.count_messages(t) == 3 and store.count_messages(t, True) == 6
    assert store.get_thread(t).first()["updated_at"] == 2 * 9_999_999_999_999

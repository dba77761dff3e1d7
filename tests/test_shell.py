import pytest

from tessera.functions.scope import Unsupported
from tessera.plans.api import Connection
from tessera.plans.shell import Shell


def test_shell(spark, tmp_path, capsys):
    shell = Shell(Connection(spark, str(tmp_path)))
    shell.db.coll.insertMany([{"_id": i} for i in range(5)])
    assert shell.show("dbs") == ["test"] and shell.show("collections") == ["coll"] and shell.use("other").getName() == "other"
    shell.config.set("displayBatchSize", 3)
    first = shell.page(shell.use("test").coll.find().sort({"_id": 1}))
    assert [d["_id"] for d in first.documents] == [0, 1, 2] and first.cursorHasMore
    assert len(shell.it().documents) == 2 and shell.it().documents == []
    assert shell.config.reset("displayBatchSize") and shell.config.get("displayBatchSize") == 20
    shell.print("a", {"b": 1})
    assert capsys.readouterr().out == 'a {"b": 1}\n'
    for call in (lambda: shell.show("users"), lambda: shell.load("x.js")):
        with pytest.raises(Unsupported):
            call()
    with pytest.raises(KeyError):
        shell.config.set("nope", 1)

def test_public_names():
    import runledger

    assert runledger.Session.open and runledger.inspect_source and runledger.compare_sessions


def test_exit_codes(tmp_path, capsys):
    from runledger.cli import main

    assert main(["--workspace", str(tmp_path), "sessions"]) == 0
    assert main(["--workspace", str(tmp_path), "report", "absent"]) == 2 and "error" in capsys.readouterr().err
    assert main(["--workspace", str(tmp_path), "doctor", "--json"]) == 0

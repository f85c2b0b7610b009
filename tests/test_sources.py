import wave

import numpy as np

from tidemark.sources import readers


def test_readers(spark, tmp_path):
    (tmp_path / "Session3_PatientInfo.csv").write_text("DeviceID,PatientID,Gender,Age\nA1,7,Female,30\n")
    r = readers.read_patients(spark, str(tmp_path / "Session3_PatientInfo.csv")).first()
    assert (r.DeviceID, r.Age, r.session_id) == ("A1", 30, 3)
    (tmp_path / "acc_exp02_user05.txt").write_text("0.1 0.2 0.3\n1 2 3\n")
    rows = readers.read_acc_text(spark, str(tmp_path / "acc_exp*_user*.txt")).orderBy("seq").collect()
    assert [(x.exp, x.user, x.seq, x.z) for x in rows] == [(2, 5, 0, 0.3), (2, 5, 1, 3.0)]
    (tmp_path / "labels.txt").write_text("2 5 1 10 20\n")
    assert readers.read_interval_labels(spark, str(tmp_path / "labels.txt")).first().end == 20
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes((np.arange(2500) * 10).astype("<i2").tobytes())
    got = readers.read_audio(spark, str(tmp_path / "*.wav"), 1.0).orderBy("chunk_id").collect()
    assert [len(x.pcm) for x in got] == [1000, 1000, 500] and abs(got[1].pcm[0] - 10000 / 32768) < 1e-6

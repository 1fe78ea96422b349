import pickle

from lattica.llm import shared
from lattica.llm.quality import _features
from lattica.llm.tokens import encoder, vocabulary_path


def test_a_worker_holds_one_operator_at_a_time():
    path = vocabulary_path()
    first = encoder(path)
    assert encoder(path) is first
    features = _features()
    assert _features() is features and encoder.cache_info().currsize == 0
    assert encoder(path) is not first and _features.cache_info().currsize == 0
    shared.release()
    assert not any(f.cache_info().currsize for f in shared._RESIDENT)
    assert pickle.loads(pickle.dumps(encoder)) is encoder  # sent to workers by name

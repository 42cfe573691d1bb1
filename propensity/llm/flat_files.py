"""Flat files in the shared folder: append while writing, read byte ranges from a memory map or a remote store."""

from __future__ import annotations

import uuid


class FlatWriter:
    """Files of one writing attempt, ``{stem}.{kind}``. The stem is new, so attempts of one task do not meet."""

    def __init__(self, folder: str, name: str, kinds: tuple[str, ...]):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        self.stem = f"{name}-{uuid.uuid4().hex}"
        self._out = {kind: store.open_output_stream(f"{base}/{self.stem}.{kind}", compression=None) for kind in kinds}

    def append(self, kind: str, values) -> None:
        """Append a numpy array as its bytes, or bytes."""
        self._out[kind].write(values if isinstance(values, bytes) else values.tobytes())

    def close(self) -> None:
        for out in self._out.values():
            out.close()


class FlatFile:
    """Random reads of a flat file; a memory map where the store is a local or mounted folder."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        local = isinstance(store, fs.LocalFileSystem)
        self._file = pa.memory_map(inside) if local and store.get_file_info(inside).size else store.open_input_file(inside)

    def array(self, kind: str, first: int, count: int):
        """``count`` numbers of a numpy type from the ``first`` one on; of a memory map no copy is made."""
        import numpy as np

        dtype = np.dtype(kind)
        self._file.seek(first * dtype.itemsize)
        buffer = self._file.read_buffer(count * dtype.itemsize)
        if buffer.size != count * dtype.itemsize:
            raise ValueError("a flat file is shorter than its list says")
        return np.frombuffer(buffer, dtype)

    def close(self) -> None:
        self._file.close()

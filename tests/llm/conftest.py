import os

# Many small matrices: threads of the linear-algebra library only get in Spark's way.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

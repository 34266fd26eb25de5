"""Scalars of workflow files, what their expressions read, and taint."""

from corvid.operators.workflows import scalars, scalars_of, taints

TEXT = """name: x
env:
  A: ${{ github.head_ref }}   # why
on: [push]
jobs:
  first:
    outputs:
      o: ${{ steps.s.outputs.k }}
      gone: ${{ steps.none.outputs.k }}
    steps:
    - run: echo "${{ env.LATER }}"
    - id: s
      env:
        A: "it's: fixed"
        B: '${{ inputs.x }} ''quoted'''
      run: |
        echo "k=$B" >> $GITHUB_OUTPUT

        echo "LATER=${A}" >> "$GITHUB_ENV"
    -
      name: ${{ env.A }}
      run: >-
        echo ${{ env.LATER }}
        ${{ 'github.head_ref' }}
  second:
    needs: first
    steps:
      - run: echo ${{ needs.first.outputs.o }} ${{ needs.first.outputs.gone }} ${{ needs['other'].outputs.o }} ${{ env.LATER }}
"""


def test_scalars_of_blocks_sequences_and_quotes():
    got = {(n, a): v for n, a, v in scalars_of(TEXT)}
    assert got[14, "jobs.first.steps[1].env.A"] == "it's: fixed"
    assert got[15, "jobs.first.steps[1].env.B"] == "${{ inputs.x }} 'quoted'"
    assert got[16, "jobs.first.steps[1].run"] == 'echo "k=$B" >> $GITHUB_OUTPUT\n\necho "LATER=${A}" >> "$GITHUB_ENV"'
    assert got[22, "jobs.first.steps[2].run"] == "echo ${{ env.LATER }} ${{ 'github.head_ref' }}"
    assert got[4, "on"] == "[push]" and got[26, "jobs.second.needs"] == "first"
    assert list(scalars_of("")) == [] and list(scalars_of("}}{\n\t\na: b\n  c\n")) == [(1, "", "}}{"), (3, "a", "b"), (4, "a", "c")]
    assert len(list(scalars_of("a:\n" + "  - b: c\n" * 20_000))) == 20_000


def test_taint_goes_through_environments_and_outputs(spark):
    files = [("a.yml", TEXT), ("b.yml", None), ("c.yml", ""), ("d.yml", "env:\n  X: ${{ env.Y }}\n  Y: ${{ env.X }}\n"), ("e.yml", "no colon ${{ github.head_ref }}\n- x: ${{ github.event.commits[0].message }}\n")]
    rows = spark.createDataFrame(files, "path string, content string").selectExpr("path", "content", "1 AS line_no", "2 AS address")
    found = {(r.path, r.line_no, r.seq): r.taint for r in taints(rows).collect()}
    assert found == {
        ("a.yml", 3, 0): "user",
        ("a.yml", 8, 0): "user",  # through B and the output of the step
        ("a.yml", 9, 0): "unknown",
        ("a.yml", 11, 0): "trusted",  # nothing has written the name yet
        ("a.yml", 15, 0): "user",
        ("a.yml", 21, 0): "user",  # the file's A, not that of another step
        ("a.yml", 22, 0): "trusted",  # the step's own A is fixed
        ("a.yml", 22, 1): "trusted",
        ("a.yml", 28, 0): "user",
        ("a.yml", 28, 1): "trusted",  # defined, though by something unknown
        ("a.yml", 28, 2): "unknown",
        ("a.yml", 28, 3): "trusted",  # names written in one job stay there
        ("d.yml", 2, 0): "trusted",
        ("d.yml", 3, 0): "trusted",
        ("e.yml", 1, 0): "user",
        ("e.yml", 2, 0): "user",
    }
    assert scalars(rows.where("content IS NULL")).count() == 0

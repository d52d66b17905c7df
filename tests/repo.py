"""A small repository for the tests, with a case for each rule of resolution and binding."""

FILES = {
    "go.mod": "module example.com/m/v2 // the module\n\ngo 1.21\n",
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\n\t"example.com/m/v2/auth"\n\th "example.com/m/v2/dirhelper"\n\t"example.org/dep"\n\t"example.com/m/v2/missing"\n\t"example.com/m/v2/nested/inner"\n)\n\nfunc main() {\n\tfmt.Println(auth.Login("x"))\n\th.Help()\n\tdep.Do()\n\tmissing.Gone()\n\thelper()\n\tunknown()\n\tvar s auth.Session\n\ts.Open()\n\ts.Close()\n\t_ = s.Name\n}\n',
    "util.go": "package main\n\nfunc helper() int { return limit }\n\nconst limit = 3\n",
    "auth/auth.go": 'package auth\n\n// Session is open or not.\ntype Session struct {\n\tName string\n}\n\n// Login logs in.\nfunc Login(user string) *Session { return open(user) }\n\nfunc open(user string) *Session { return &Session{Name: user} }\n\nfunc (s *Session) Open() {}\n',
    "auth/auth_test.go": 'package auth\n\nfunc check() { _ = Login("a"); fixture() }\n\nfunc fixture() {}\n',
    "auth/extern_test.go": 'package auth_test\n\nimport "example.com/m/v2/auth"\n\nfunc outside() { auth.Login("b") }\n',
    "dirhelper/h.go": "package helpersvc\n\nfunc Help() {}\n",
    "vendor/example.org/dep/dep.go": "package dep\n\nfunc Do() {}\n",
    "nested/go.mod": "module example.com/nested\n",
    "nested/inner/i.go": "package inner\n\nfunc In() {}\n",
    "deep/internal/fs/fs.go": "package fs\n\nfunc Read() {}\n",
    "deep/user/u.go": 'package user\n\nimport "example.com/m/v2/deep/internal/fs"\n\nfunc U() { fs.Read() }\n',
    "outside/o.go": 'package outside\n\nimport "example.com/m/v2/deep/internal/fs"\n\nfunc O() { fs.Read() }\n',
    "rel/r.go": 'package rel\n\nimport (\n\t"./sub"\n\t"../../../up"\n)\n\nfunc R() { sub.S() }\n',
    "rel/sub/s.go": "package sub\n\nfunc S() {}\n",
    "dotted/d.go": 'package dotted\n\nimport . "example.com/m/v2/vals"\n\nvar Own = 1\n\nvar sum = Value + Own + Both\n\nvar Both = 2\n',
    "vals/v.go": "package vals\n\nvar Value = 1\n\nvar Both = 3\n",
    "meth/m.go": "package meth\n\ntype A struct{}\n\ntype B struct{}\n\nfunc (A) One() {}\n\nfunc (A) Two() {}\n\nfunc (B) Two() {}\n\nfunc use(a A) { a.One(); a.Two(); a.String() }\n",
    "tags/linux.go": "package tags\n\nfunc Sys() {}\n",
    "tags/windows.go": "package tags\n\nfunc Sys() {}\n\nfunc Call() { Sys() }\n",
    "nopkg/n.go": "// nothing here\n",
    "notes.md": "notes\n",
    "tool.py": "x = 1\n",
}


def write(root, files=None):
    for path, text in (files or FILES).items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return root
